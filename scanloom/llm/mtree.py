"""Exact top-k search (operator 2): best-first search of M-trees.

Vectors become integers, floor(256 * x), of any size. A further coordinate
sqrt(M - |v|^2), with M the largest squared norm, and 0 for a query, makes the largest
inner product the smallest Euclidean distance, so the triangle inequality holds.
Vectors are dealt to the nearest of some pivots, large shares are split by a hash
into trees of about the same size, however many these are, and a task builds one
M-tree of each share, as pages of routing entries (pivot, covering radius, distance
to the parent's pivot, child) or of vectors. A query is searched in a tree of its
nearest pivot first; its k-th distance then tells which other pivots, and which of
their trees, can hold a better one. A search takes the page with the smallest bound
first, and an entry's distance is computed only if the stored distances can't rule
it out. Bounds are floating point with room for its error; a score is exact: where
53 bits could be too few, whole numbers of Python decide.

Of equal vectors a page keeps the k + 1 smallest ids, as a query can't return
more. Defined results: vectors that are null, empty or hold null or non-finite
components (or such as 256 times leave the doubles) take no part, nor do those of
another length than the most frequent one, nor rows with a null id; a row that
repeats another counts once; ties go to the smaller id; a score that 64 bits can't
hold is given as the nearest that they can, and ranked by what it is; very long
vectors make larger pages; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SCALE, K, EVERY = 256, 5, 50
#: Vectors of a tree (about), pivots at most, and tree roots that are broadcast at most: of more, those of a pivot are joined to.
TREE, PIVOTS, ROOTS = 8192, 256, 16384
LEAF, FAN = 128, 32
#: Queries that a task searches one tree for.
CHUNK = 4096

PAGE = "tree long, page int, leaf boolean, vecs binary, extra binary, child binary, ids binary, n_ids binary"
HITS = "query_id long, vec_id long, score long, size double, reach double"
LONG = (-(2**63), 2**63 - 1)


@dataclass
class Space:
    """How vectors are written: ``wide`` ones as integers in doubles, others as 32-bit integers; geometry is in units of ``2 ** shift``."""

    dim: int
    wide: bool
    shift: int
    most: float = 0.0

    @property
    def exact(self) -> bool:
        """Whether any sum of products stays within the integers that doubles hold."""
        return not self.shift and self.most < 2.0**53

    @property
    def dtype(self) -> str:
        return "<f8" if self.wide else "<i4"

    def raw(self, column) -> np.ndarray:
        return np.frombuffer(b"".join(column), self.dtype).reshape(-1, self.dim)

    def matrix(self, column) -> np.ndarray:
        return np.ldexp(self.raw(column).astype(np.float64), -self.shift)

    def lift(self, v: np.ndarray) -> np.ndarray:
        """Vectors with the further coordinate."""
        return np.c_[v, np.sqrt(np.maximum(0, self.most - (v * v).sum(axis=1)))]

    def scaled(self, score: int) -> float:
        return float(score >> (2 * self.shift))

    def slack(self, norm: float) -> float:
        """More than the error of a distance that floating point gives."""
        return 6e-8 * math.sqrt((self.dim + 8) * (1 + norm + self.most))


def integers(vectors: DataFrame) -> tuple[DataFrame, Space]:
    """(vec_id, vec) of the vectors that take part, and how ``vec`` is written."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**1016))
    own = own.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.coalesce(good, F.lit(False)))
    own = own.withColumn("n", F.size("v"))
    top = F.greatest(F.array_max("v"), -F.array_min("v"))
    most = own.groupBy("n").agg(F.count("*").alias("c"), F.max(top).alias("top")).orderBy(F.desc("c"), "n").first()
    dim, top = (most["n"], SCALE * most["top"]) if most else (1, 0.0)
    space = Space(dim, top >= 2.0**31, max(0, math.frexp(top)[1] - 200))
    dtype = space.dtype

    def run(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            data = np.floor(SCALE * flat).astype(dtype).reshape(len(batch), -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d.tobytes() for d in data], pa.binary())], ["vec_id", "vec"])

    return own.where(F.col("n") == dim).select("vec_id", "v").mapInArrow(run, "vec_id long, vec binary"), space


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)))


def build(lifted: np.ndarray) -> list[dict]:
    """Pages of an M-tree over the rows of ``lifted``; page 0 is the root's."""
    pages: list[dict] = []

    def grow(rows: np.ndarray, parent: int | None) -> int:
        number = len(pages)
        pages.append({})
        base = None if parent is None else lifted[parent][None]
        if len(rows) <= LEAF:
            near = np.zeros(len(rows)) if base is None else _distances(lifted[rows], base)[:, 0]
            pages[number] = {"leaf": True, "rows": rows, "radius": np.zeros(len(rows)), "near": near, "child": np.zeros(len(rows), np.int32)}
            return number
        seeds = rows[np.linspace(0, len(rows) - 1, min(FAN, max(2, -(-2 * len(rows) // LEAF)))).astype(int)]
        seeds = np.unique(seeds)
        to_seed = _distances(lifted[rows], lifted[seeds]).argmin(axis=1)
        groups = [rows[to_seed == k] for k in range(len(seeds))]
        groups = [g for g in groups if len(g)]
        if len(groups) == 1:  # nothing tells these apart
            groups = np.array_split(rows, 2)
        pivots, radius, child = [], [], []
        for g in groups:
            centre = lifted[g].mean(axis=0)
            p = g[int(((lifted[g] - centre) ** 2).sum(axis=1).argmin())]
            pivots.append(p)
            radius.append(float(_distances(lifted[g], lifted[p][None]).max()))
            child.append(grow(g, p))
        chosen = np.array(pivots)
        near = np.zeros(len(chosen)) if base is None else _distances(lifted[chosen], base)[:, 0]
        pages[number] = {"leaf": False, "rows": chosen, "radius": np.array(radius), "near": near, "child": np.array(child, np.int32)}
        return number

    grow(np.arange(len(lifted)), None)
    return pages


class Tree:
    """The pages of one tree, read from their rows. ``computed`` counts the distances that searches had to compute."""

    def __init__(self, rows: pd.DataFrame, space: Space):
        self.pages, self.space, self.computed, self.size = {}, space, 0, 0
        for r in rows.itertuples(index=False):
            raw = space.raw([r.vecs])
            extra = np.frombuffer(r.extra, "<f8").reshape(2, -1)
            ids = np.frombuffer(r.ids, "<i8")
            ends = np.cumsum(np.frombuffer(r.n_ids, "<i4"))
            self.size += len(ends)
            self.pages[r.page] = (r.leaf, raw, space.matrix([r.vecs]), extra[0], extra[1], np.frombuffer(r.child, "<i4"), np.split(ids, ends[:-1]) if len(ends) else [])

    def search(self, q: np.ndarray, own: int, k: int, reach: float) -> list[tuple[int, int]]:
        """The best (-score, id) of this tree that lie within ``reach``, at most ``k``; ``q`` is as vectors are written."""
        space = self.space
        whole = None if space.exact else [int(x) for x in q.tolist()]
        q = np.ldexp(q.astype(np.float64), -space.shift)
        norm, most = float(q @ q), space.most
        slack = space.slack(norm)
        error = 0.0 if space.exact else 1 + (space.dim + 2) * 2.0**-51 * math.sqrt(norm) * math.sqrt(most)
        best: list[tuple[int, int]] = []
        queue = [(0.0, 0, -1.0)]
        while queue:
            bound, number, to_parent = heapq.heappop(queue)
            if bound > reach + slack:
                break
            leaf, raw, vecs, radius, near, child, ids = self.pages[number]
            at = np.arange(len(vecs))
            if to_parent >= 0:
                at = np.flatnonzero(np.abs(to_parent - near) - radius <= reach + slack)
                if not len(at):
                    continue
                vecs = vecs[at]
            self.computed += len(at)
            dot = vecs @ q
            if leaf:
                floor = space.scaled(-best[k - 1][0]) if len(best) >= k else -math.inf
                limit = max(floor, (norm + most - (reach + slack) ** 2) / 2) if reach < math.inf else floor
                for i in np.flatnonzero(dot >= limit - error).tolist():
                    score = int(dot[i]) if whole is None else sum(a * int(b) for a, b in zip(whole, raw[at[i]].tolist(), strict=True))
                    best += [(-score, int(x)) for x in ids[at[i]] if x != own]
                best = sorted(best)[:k]
                if len(best) >= k:
                    reach = min(reach, math.sqrt(max(0.0, norm + most - 2 * space.scaled(-best[k - 1][0]))))
            else:
                far = np.sqrt(np.maximum(0, norm + most - 2 * dot))
                low = np.maximum(far - radius[at], bound)
                for i in np.flatnonzero(low <= reach + slack).tolist():
                    heapq.heappush(queue, (float(low[i]), int(child[at[i]]), float(far[i])))
        return best


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each row whose id ``every`` divides."""
    sc = vectors.sparkSession.sparkContext
    raw, space = integers(vectors)
    rows = cut(raw.distinct())
    first = Window.partitionBy("vec").orderBy("vec_id")
    least = rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)

    def norms(batches):
        for batch in batches:
            v = space.matrix(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((v * v).sum(axis=1))], ["vec", "ids", "norm"])

    unique = least.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    unique = cut(unique.mapInArrow(norms, "vec binary, ids array<long>, norm double"))
    stats = unique.agg(F.count("*").alias("n"), F.max("norm").alias("most")).first()
    n, space.most = stats["n"], float(stats["most"] or 0) * (1 + 1e-12)
    # A fixed number of pivots, drawn by a hash of the vector.
    drawn = unique.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(max(1, min(PIVOTS, n // TREE))).collect()
    pivots = sc.broadcast(space.lift(space.matrix([r["vec"] for r in drawn])) if n else np.zeros((1, space.dim + 1)))

    def place(batches):
        for batch in batches:
            far = _distances(space.lift(space.matrix(batch.column(0).to_pylist())), pivots.value)
            own = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own), pa.array(far[np.arange(len(own)), own])], ["vec", "ids", "pivot", "far"])

    placed = cut(unique.select("vec", "ids").mapInArrow(place, "vec binary, ids array<long>, pivot long, far double"))
    # At most PIVOTS rows. A share is split so that its trees have about TREE vectors.
    shares = placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("radius")).orderBy("pivot").collect()
    parts = {r["pivot"]: -(-r["n"] // TREE) for r in shares}
    split = F.coalesce(*(F.when(F.col("pivot") == p, F.lit(c)) for p, c in parts.items() if c > 1), F.lit(1))
    tree = F.col("pivot") * (1 << 40) + F.pmod(F.xxhash64("vec"), split)
    pages = cut(placed.select(tree.alias("tree"), "vec", "ids").groupBy("tree").applyInPandas(_grower(space), PAGE))

    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vec")
    chunks = -(-max(1, queries.count()) // CHUNK)
    queries = queries.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)))
    route = _Routes(space, pages.where("page = 0"), pivots, {r["pivot"]: r["radius"] for r in shares}, parts)

    def search(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(asked):
            tree, q = Tree(own, space), space.raw(asked["vec"])
            for i, (query_id, reach) in enumerate(zip(asked["query_id"].tolist(), asked["reach"].tolist(), strict=True)):
                hits, end = tree.search(q[i], query_id, k, reach), math.inf
                if len(hits) >= k:
                    v = np.ldexp(q[i].astype(np.float64), -space.shift)
                    end = math.sqrt(max(0.0, float(v @ v) + space.most - 2 * space.scaled(-hits[k - 1][0])))
                out += [(query_id, vec_id, min(max(-minus, LONG[0]), LONG[1]), space.scaled(-minus), end) for minus, vec_id in hits]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "size", "reach"])

    def searched(routed: DataFrame) -> DataFrame:
        asked = routed.select(F.col("tree").alias("of_tree"), F.col("chunk").alias("of_chunk")).distinct()
        copies = pages.join(asked, F.col("tree") == F.col("of_tree")).drop("tree")
        return routed.groupBy("tree", "chunk").cogroup(copies.groupBy("of_tree", "of_chunk")).applyInPandas(search, HITS)

    home = cut(searched(route.home(queries.withColumn("reach", F.lit(float("inf"))))))
    reached = home.groupBy("query_id").agg(F.min("reach").alias("known"))
    known = queries.join(reached, "query_id", "left").select("query_id", "vec", "chunk", F.coalesce("known", F.lit(float("inf"))).alias("reach"))
    away = searched(cut(route.others(known)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("size"), "vec_id")
    hits = home.union(away).select("query_id", "vec_id", "score", "size").distinct()
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _grower(space: Space):
    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec", ignore_index=True)
        vecs, ids = rows["vec"].tolist(), rows["ids"].tolist()
        out = []
        for number, p in enumerate(build(space.lift(space.matrix(vecs)))):
            own = [ids[i] for i in p["rows"]] if p["leaf"] else []
            flat = np.concatenate(own) if own else np.zeros(0)
            out.append(
                (
                    key[0],
                    number,
                    p["leaf"],
                    b"".join(vecs[i] for i in p["rows"]),
                    np.stack([p["radius"], p["near"]]).astype("<f8").tobytes(),
                    p["child"].astype("<i4").tobytes(),
                    flat.astype("<i8").tobytes(),
                    np.array([len(x) for x in own], "<i4").tobytes(),
                )
            )
        return pd.DataFrame(out, columns=["tree", "page", "leaf", "vecs", "extra", "child", "ids", "n_ids"])

    return grow


class _Routes:
    """Which trees a query goes to: one of its nearest pivot, then the others that its reach doesn't rule out.

    Pivots are few and broadcast, with the radius of their share. The trees' roots are
    broadcast too if they are ROOTS at most; else those of the pivots within reach are
    joined to.
    """

    ASK = "query_id long, vec binary, chunk long, reach double, tree long"

    def __init__(self, space: Space, tops: DataFrame, pivots, radius: dict[int, float], parts: dict[int, int]):
        self.space, self.pivots, self.parts = space, pivots, parts
        self.radius = np.array([radius.get(p, -np.inf) for p in range(len(pivots.value))])
        self.count = np.array([parts.get(p, 0) for p in range(len(pivots.value))])
        self.roots = tops.select("tree", "vecs", "extra").mapInArrow(self._root, "tree long, centre binary, radius double")
        self.few = sum(parts.values()) <= ROOTS
        if self.few:
            own = sorted(self.roots.collect(), key=lambda r: r["tree"])
            centres = np.frombuffer(b"".join(r["centre"] for r in own)).reshape(-1, space.dim + 1)
            self.known = tops.sparkSession.sparkContext.broadcast((np.array([r["tree"] for r in own], np.int64), centres, np.array([r["radius"] for r in own])))

    def _root(self, batches):
        """The ball around what a root page holds."""
        for batch in batches:
            centre, radius = [], []
            for v, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                points = self.space.lift(self.space.matrix([v]))
                middle = points.mean(axis=0)
                far = np.sqrt(((points - middle) ** 2).sum(axis=1)) + np.frombuffer(x, "<f8").reshape(2, -1)[0]
                centre.append(middle.tobytes())
                radius.append(float(far.max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(centre, pa.binary()), pa.array(radius)], ["tree", "centre", "radius"])

    def __getstate__(self):  # what tasks need
        return {k: v for k, v in self.__dict__.items() if k not in ("roots",)}

    def _home(self, ids: list[int], q: np.ndarray) -> np.ndarray:
        """A tree of the nearest pivot that has one, which the query's id chooses."""
        far = _distances(np.c_[q, np.zeros(len(q))], self.pivots.value)
        far[:, self.count == 0] = np.inf
        own = far.argmin(axis=1)
        return own.astype(np.int64) * (1 << 40) + np.array(ids, np.int64) // 7 % np.maximum(self.count[own], 1)

    def _within(self, q: np.ndarray, centres: np.ndarray, radii: np.ndarray, reach: np.ndarray) -> np.ndarray:
        norm = (q * q).sum(axis=1)
        low = _distances(np.c_[q, np.zeros(len(q))], centres) - radii
        return low <= (reach + np.array([self.space.slack(x) for x in norm]))[:, None]

    def home(self, queries: DataFrame) -> DataFrame:
        def run(batches):
            for batch in batches:
                trees = self._home(batch.column(0).to_pylist(), self.space.matrix(batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(trees)], ["query_id", "vec", "chunk", "reach", "tree"])

        return queries.mapInArrow(run, self.ASK)

    def others(self, queries: DataFrame) -> DataFrame:
        names = ["query_id", "vec", "chunk", "reach", "tree"]

        def of_few(batches):
            trees, centres, radii = self.known.value
            for batch in batches:
                q = self.space.matrix(batch.column(1).to_pylist())
                ok = self._within(q, centres, radii, batch.column(3).to_numpy(zero_copy_only=False))
                ok &= trees[None] != self._home(batch.column(0).to_pylist(), q)[:, None]
                i, j = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(i)) for c in batch.columns), pa.array(trees[j])], names)

        def of_pivots(batches):
            for batch in batches:
                q = self.space.matrix(batch.column(1).to_pylist())
                i, j = np.nonzero(self._within(q, self.pivots.value, self.radius, batch.column(3).to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(i)) for c in batch.columns), pa.array(j.astype(np.int64))], [*names[:4], "pivot"])

        def of_roots(batches):
            for batch in batches:
                q = self.space.matrix(batch.column(1).to_pylist())
                centres = np.frombuffer(b"".join(batch.column(5).to_pylist())).reshape(-1, self.space.dim + 1)
                norm = (q * q).sum(axis=1)
                low = np.sqrt(((np.c_[q, np.zeros(len(q))] - centres) ** 2).sum(axis=1)) - batch.column(6).to_numpy(zero_copy_only=False)
                reach = batch.column(3).to_numpy(zero_copy_only=False) + np.array([self.space.slack(x) for x in norm])
                ok = (low <= reach) & (batch.column(4).to_numpy() != self._home(batch.column(0).to_pylist(), q))
                yield pa.RecordBatch.from_arrays(batch.columns[:5], names).filter(pa.array(ok))

        if self.few:
            return queries.mapInArrow(of_few, self.ASK)
        near = queries.mapInArrow(of_pivots, "query_id long, vec binary, chunk long, reach double, pivot long")
        roots = self.roots.withColumn("pivot", F.shiftright("tree", 40))
        met = near.join(roots, "pivot").select("query_id", "vec", "chunk", "reach", "tree", "centre", "radius")
        return met.mapInArrow(of_roots, self.ASK)


#: Every query against every row, in DuckDB.
ORACLE = f"""
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= {K}
"""
