"""Resampling, stencils, distance fields, quantiles and suppression against numpy, on small and on awkward input."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.operators import fields, instances, ranks, resample, stencils, suppression, voxels
from scanloom.plans import grids

VOX = "case string, x long, y long, z long, value double"


def rows(case, a):
    return [(case, *map(int, p), float(a[p])) for p in np.ndindex(a.shape)]


def frame(spark, data, more=()):
    """Voxels with further columns whose names the operators use inside."""
    return spark.createDataFrame(data, VOX).selectExpr("*", "1 AS d2", "'a' AS low", "2 AS tx", "3 AS w", *more).repartition(3)


def array(df, case, shape, value="value"):
    out = np.zeros(shape)
    for r in df.where(F.col("case") == case).collect():
        out[r["x"], r["y"], r["z"]] += r[value]
    return out


# -- resampling ------------------------------------------------------------------


def sampled(a, size, m, padding="border", nearest=False):
    """By hand: the eight voxels around each target's place."""
    out = np.zeros(size)
    for t in np.ndindex(*size):
        p = np.round(m[:3, :3] @ t + m[:3, 3], 9)
        if padding == "border":
            p = np.clip(p, 0, np.array(a.shape) - 1)
        if nearest:
            q = tuple(np.rint(p).astype(int))
            out[t] = a[q] if all(0 <= v < n for v, n in zip(q, a.shape)) else 0
            continue
        low = np.floor(p).astype(int)
        for c in np.ndindex(2, 2, 2):
            q, w = low + c, np.prod(np.where(c, p - low, 1 - (p - low)))
            if w > 0 and all(0 <= v < n for v, n in zip(q, a.shape)):
                out[t] += w * a[tuple(q)]
    return out


@pytest.mark.parametrize("padding", ["border", "zeros"])
@pytest.mark.parametrize("mode", ["linear", "nearest"])
def test_affine_resampling(spark, padding, mode):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 5, 4, 3))
    m = np.array([[0.9, 0.3, 0, -1.2], [-0.4, 0.8, 0.1, 0.5], [0, 0.2, 1.1, 0.25]])
    df = frame(spark, rows("a", a) + rows("b", b) + [(None, 0, 0, 0, 1.0)])
    got = resample.resampled(df, resample.one_plan(df, (5, 4, 3), (6, 5, 4), m), mode, padding)
    for case, v in (("a", a), ("b", b)):
        assert np.allclose(array(got, case, (6, 5, 4)), sampled(v, (6, 5, 4), m, padding, mode == "nearest"))
    assert got.where("x < 0 OR x > 5 OR y > 4 OR z > 3").count() == 0


def test_resizing_keeps_a_plane_and_the_size(spark):
    ramp = np.add.outer(np.add.outer(np.arange(4.0), 2 * np.arange(3)), np.zeros(2))
    df = frame(spark, rows("a", ramp))
    got = array(resample.resized(df, (4, 3, 2), (7, 5, 3), align_corners=True), "a", (7, 5, 3))
    assert np.allclose(got, np.add.outer(np.add.outer(np.arange(7) / 2, np.arange(5.0)), np.zeros(3)))
    assert np.allclose(array(resample.resized(df, (4, 3, 2), (4, 3, 2)), "a", (4, 3, 2)), ramp)


def test_sparse_null_and_repeated_voxels(spark):
    df = frame(spark, [("a", 0, 0, 0, 2.0), ("a", 0, 0, 0, 1.0), ("a", 1, 0, 0, None), ("a", 3, 0, 0, 4.0)])
    got = array(resample.resized(df, (4, 1, 1), (7, 1, 1), align_corners=True), "a", (7, 1, 1))[:, 0, 0]
    assert got.tolist() == [3.0, 1.5, 0, 0, 0, 2.0, 4.0]
    assert resample.resampled(df.limit(0), resample.one_plan(df.limit(0), (4, 1, 1), (2, 1, 1), np.eye(4))).collect() == []


def test_spacing_plans(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(5, 4, 3))
    turned = np.array([[0, -2.0, 0, 10], [1.0, 0, 0, -3], [0, 0, 3.0, 1], [0, 0, 0, 1]])
    size, new = resample.respaced((5, 4, 3), turned, (1.5, 1.0, -1))
    assert size.tolist() == [4, 7, 3] and np.allclose(resample.spacing_of(new), [1.5, 1.0, 3.0])
    assert np.allclose(new[:3, 3], turned[:3, 3])  # both begin at the same corner
    headers = spark.createDataFrame([("a", [5, 4, 3], turned.reshape(-1).tolist()), (None, [1, 1, 1], [0.0] * 16), ("b", None, None)], "case string, shape array<int>, affine array<double>")
    plan = resample.spacing_plans(headers, (1.5, 1.0, -1))
    assert plan.count() == 1
    got = array(resample.resampled(frame(spark, rows("a", a)), plan), "a", (4, 7, 3))
    assert np.allclose(got, sampled(a, (4, 7, 3), np.linalg.solve(turned, new)))
    assert np.allclose(sampled(a, (4, 7, 3), np.linalg.solve(turned, new))[0, 0], a[0, 0])


@pytest.mark.parametrize("codes", ["RAS", "LPS", "PIR", "SLA"])
def test_orientation_moves_voxels_with_their_world_places(spark, codes):
    affine = np.array([[0.1, 0, -1.0, 9], [1.5, 0.2, 0, 0], [0, -2.0, 0.1, 3], [0, 0, 0, 1]])
    assert resample.axis_codes(affine) == "AIL"
    order, flips = resample.reorientation(affine, codes)
    new = resample.reoriented_affine(affine, (4, 3, 2), order, flips)
    assert resample.axis_codes(new) == codes
    data = [("a", x, y, z, float(x * 100 + y * 10 + z)) for x, y, z in np.ndindex(4, 3, 2)]
    for r in resample.reoriented(frame(spark, data), (4, 3, 2), order, flips).collect():
        v = int(r["value"])
        old = np.array([v // 100, v // 10 % 10, v % 10, 1])
        assert np.allclose(new @ [r["x"], r["y"], r["z"], 1], affine @ old)
    with pytest.raises(ValueError):
        resample.reorientation(affine, "RLS")


# -- stencils --------------------------------------------------------------------


def along(a, w, axis, edge):
    r = len(w) // 2
    mode = {"zeros": "constant", "repeat": "edge", "mirror": "symmetric", "valid": "constant"}[edge]
    padded = np.pad(a, [(r, r) if k == axis else (0, 0) for k in range(a.ndim)], mode=mode)
    out = sum(x * np.take(padded, range(k, k + a.shape[axis]), axis) for k, x in enumerate(w))
    return np.take(out, range(r, a.shape[axis] - r), axis) if edge == "valid" else out


@pytest.mark.parametrize("edge", ["zeros", "repeat", "mirror", "valid"])
def test_stencils_and_their_edges(spark, edge):
    a = np.random.default_rng(3).normal(size=(6, 5, 7))
    w = [0.5, -1.0, 2.0, 0.0, 0.25]
    got = stencils.separable(frame(spark, rows("a", a) + rows("b", a * 2)), a.shape, {"x": w, "z": w}, edge=edge)
    want = along(along(a, w, 0, edge), w, 2, edge)
    assert np.allclose(array(got, "a", want.shape), want) and np.allclose(array(got, "b", want.shape), 2 * want)


def test_stencils_that_do_not_fit(spark):
    df = frame(spark, rows("a", np.ones((2, 2, 2))))
    with pytest.raises(ValueError):
        stencils.convolved(df, "x", 2, [1.0] * 7, edge="mirror")
    with pytest.raises(ValueError):
        stencils.convolved(df, "x", 2, [1.0] * 2)
    assert stencils.convolved(df, "x", 2, [1.0] * 3, edge="valid").count() == 0
    assert stencils.convolved(df.limit(0), "x", 2, [1.0] * 3).count() == 0


def test_smoothing_weights():
    w = stencils.gaussian_weights(1.0)
    assert len(w) == 9 and w == w[::-1] and abs(sum(w) - 1) < 1e-4
    assert stencils.gaussian_weights(0.01) == [0.0, 1.0, 0.0]
    assert abs(sum(stencils.sampled_gaussian(11, 1.5)) - 1) < 1e-12


def test_sharpening(spark):
    a = np.random.default_rng(4).normal(size=(5, 4, 3))

    def smooth(v, sigma):
        for k in range(3):
            v = along(v, stencils.gaussian_weights(sigma), k, "zeros")
        return v

    once = smooth(a, 0.8)
    got = stencils.gaussian_sharpen(frame(spark, rows("a", a)), a.shape, 0.8, 0.4, 3.0)
    assert np.allclose(array(got, "a", a.shape), once + 3 * (once - smooth(once, 0.4)))


def test_dense_rows(spark):
    df = frame(spark, [("a", 0, 0, 0, 1.0), ("a", 0, 0, 0, 2.0), ("a", 1, 1, 0, None), ("a", 9, 0, 0, 5.0), ("b", 1, 0, 0, 4.0)])
    got = {tuple(r) for r in stencils.dense(df, (2, 2, 1)).collect()}
    assert len(got) == 8 and ("a", 0, 0, 0, 3.0) in got and ("a", 1, 1, 0, 0.0) in got and ("b", 1, 0, 0, 4.0) in got


def similarity(a, b, window, sigma, peak=1.0):
    w = stencils.sampled_gaussian(window, sigma)

    def mean(v):
        for k in range(v.ndim):
            v = along(v, w, k, "valid")
        return v

    mx, my = mean(a), mean(b)
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    cs = (2 * (mean(a * b) - mx * my) + c2) / (mean(a * a) - mx**2 + mean(b * b) - my**2 + c2)
    return ((2 * mx * my + c1) / (mx**2 + my**2 + c1) * cs).mean(), cs.mean()


def test_windowed_similarity_in_three_dimensions(spark):
    rng = np.random.default_rng(5)
    a = rng.random((8, 7, 6))
    b = a + 0.3 * rng.random((8, 7, 6))
    data = [("a", *map(int, p), float(a[p]), float(b[p])) for p in np.ndindex(a.shape)]
    df = spark.createDataFrame(data, "case string, x long, y long, z long, p double, q double").repartition(4)
    got = stencils.ssim(df, a.shape, "p", "q", window=5, sigma=1.0, peak=2.0).first()["ssim"]
    assert abs(got - similarity(a, b, 5, 1.0, 2.0)[0]) < 1e-9
    assert abs(stencils.ssim(df, a.shape, "p", "p", window=5, sigma=None).first()["ssim"] - 1) < 1e-9
    with pytest.raises(ValueError):
        stencils.ssim(df, a.shape, "p", "q")


def test_similarity_over_scales(spark):
    rng = np.random.default_rng(6)
    a = rng.random((21, 20))
    b = np.clip(a + 0.2 * rng.normal(size=a.shape), 0, 1)
    data = [("a", *map(int, p), float(a[p]), float(b[p])) for p in np.ndindex(a.shape)]
    df = spark.createDataFrame(data, "case string, x long, y long, p double, q double")
    got = stencils.ms_ssim(df, a.shape, "p", "q", ("x", "y"), (0.3, 0.7), window=5).first()["ms_ssim"]
    pool = lambda v: v[:20, :20].reshape(10, 2, 10, 2).mean((1, 3))
    want = max(similarity(a, b, 5, 1.5)[1], 0) ** 0.3 * max(similarity(pool(a), pool(b), 5, 1.5)[0], 0) ** 0.7
    assert abs(got - want) < 1e-9


def test_contours(spark):
    a = np.zeros((6, 6, 6))
    a[1:6, 1:6, 1:6] = 1
    got = {(r["x"], r["y"], r["z"]) for r in stencils.contour(frame(spark, rows("a", a))).collect()}
    assert got == {p for p in np.ndindex(6, 6, 6) if a[p] and not (2 <= min(p) and max(p) <= 4)}


# -- distances -------------------------------------------------------------------


@pytest.mark.parametrize("step", [1.0, 0.7])
def test_lower_envelopes(step):
    rng = np.random.default_rng(7)
    f = rng.integers(0, 50, (200, 33)).astype(float)
    f[rng.random(f.shape) < 0.6] = np.inf
    f[0], f[1] = np.inf, 3.0
    i = np.arange(33)
    want = (f[:, None, :] + (step * (i[:, None] - i[None])) ** 2).min(2)
    assert np.allclose(fields.lower_envelopes(f, step), want)
    assert fields.lower_envelopes(np.zeros((0, 4))).shape == (0, 4)


def points(rng, case, n, far=30):
    return [(case, *map(int, rng.integers(-5, far, 3))) for _ in range(n)]


@pytest.mark.parametrize("spacing", [(1, 1, 1), (0.5, 2.0, 1.3)])
@pytest.mark.parametrize("cells", [1 << 21, 64])
def test_nearest_sites(spark, monkeypatch, spacing, cells):
    """One case has most of the rows; one has no site; one site lies outside all points."""
    monkeypatch.setattr(fields, "CELLS", cells)
    rng = np.random.default_rng(8)
    p = points(rng, "a", 400) + points(rng, "b", 20) + points(rng, "none", 5) + [("a", 1, 1, 1)] * 3 + [("a", None, 1, 1), (None, 1, 1, 1)]
    s = points(rng, "a", 60, 60) + [("b", 200, -90, 3)] + points(rng, "only", 5)
    schema = "case string, x long, y long, z long"
    got = fields.nearest(spark.createDataFrame(p, schema).repartition(5), spark.createDataFrame(s, schema), spacing).collect()
    want = {}
    for c, *xyz in {r for r in p if None not in r}:
        d = [math.dist(np.multiply(xyz, spacing), np.multiply(q, spacing)) for k, *q in s if k == c]
        want[c, *xyz] = min(d, default=math.inf)
    assert len(got) == len(want)
    assert all(math.isclose(r["distance"], want[r["case"], r["x"], r["y"], r["z"]], rel_tol=1e-12) or r["distance"] == want[r["case"], r["x"], r["y"], r["z"]] for r in got)


def test_distance_transform(spark):
    rng = np.random.default_rng(9)
    a = (rng.random((9, 8, 7)) < 0.9).astype(float)
    got = array(fields.distance_transform(frame(spark, rows("a", a) + [("full", 0, 0, 0, 1.0)]), a.shape, (1, 1.5, 2)), "a", a.shape)
    zeros = np.argwhere(a == 0) * (1, 1.5, 2)
    want = np.array([np.sqrt(((zeros - np.multiply(p, (1, 1.5, 2))) ** 2).sum(1)).min() if a[p] else 0 for p in np.ndindex(a.shape)]).reshape(a.shape)
    assert np.allclose(got, want)
    full = fields.distance_transform(frame(spark, [("full", 0, 0, 0, 1.0)]), (1, 1, 1)).collect()
    assert [r["value"] for r in full] == [math.inf]
    assert fields.distance_transform(frame(spark, []), (3, 3, 3)).collect() == []


def test_surface_metrics_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(10)
    schema = "id string, x long, y long, z long"
    p, t = points(rng, "a", 200) + points(rng, "p", 3), points(rng, "a", 150) + points(rng, "t", 3)
    got = {r["id"]: r for r in fields.surface_metrics(spark.createDataFrame(p, schema), spark.createDataFrame(t, schema), "id", (1, 1, 2), 3.0).collect()}
    x, y = (np.array(sorted({r[1:] for r in side if r[0] == "a"})) * (1, 1, 2) for side in (p, t))
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    ab, ba = d.min(1), d.min(0)
    assert math.isclose(got["a"]["hd"], max(ab.max(), ba.max()))
    assert math.isclose(got["a"]["hd95"], max(np.percentile(ab, 95), np.percentile(ba, 95)))
    assert math.isclose(got["a"]["asd"], (ab.mean() + ba.mean()) / 2)
    assert math.isclose(got["a"]["nsd"], ((ab <= 3).sum() + (ba <= 3).sum()) / (len(ab) + len(ba)))
    assert set(got) == {"a", "p", "t"} and all(math.isinf(got[k]["hd95"]) and got[k]["nsd"] == 0 for k in "pt")


def test_instance_maps_and_extreme_points(spark):
    data = [("a", 1, x, 0) for x in range(5)] + [("a", 2, 7, 7)]
    df = spark.createDataFrame(data, "case string, component long, x long, y long")
    got = {(r["component"], r["x"]): (r["h"], r["v"]) for r in fields.instance_maps(df).collect()}
    assert got == {(1, 0): (-1.0, 0.0), (1, 1): (-0.5, 0.0), (1, 2): (0.0, 0.0), (1, 3): (0.5, 0.0), (1, 4): (1.0, 0.0), (2, 7): (0.0, 0.0)}
    ends = {r["point"]: (r["x"], r["y"]) for r in fields.extreme_points(df, ("case",), ("x", "y")).collect()}
    assert ends == {"x_low": (0, 0), "x_high": (7, 7), "y_low": (0, 0), "y_high": (7, 7)}


# -- quantiles -------------------------------------------------------------------


@pytest.mark.parametrize("buckets", [2, 5, 4096])
def test_quantiles_at_any_fineness(spark, monkeypatch, buckets):
    monkeypatch.setattr(ranks, "BUCKETS", buckets)
    rng = np.random.default_rng(11)
    values = {"a": rng.normal(size=150).tolist(), "ties": [1.0] * 40 + [2.0] * 7, "one": [5.0], None: [3.0, 1.0], "far": [-1e308, 0.0, 1e-300, 2e-300, 1e308], "ends": [-math.inf, 0.0, 1.0, math.inf]}
    if buckets > 2:
        values["a"] += [1e12, -1e9]  # outliers
    data = [(k, v) for k, vs in values.items() for v in vs] + [("a", None), ("a", math.nan), ("empty", None)]
    shares = (0.0, 0.005, 0.3, 0.5, 0.995, 1.0)
    df = spark.createDataFrame(data, "g string, v double").selectExpr("*", "1 AS n", "2 AS share", "3 AS before").repartition(4)
    got = {(r["g"], r["share"]): r["value"] for r in ranks.quantiles(df, ["g"], "v", shares).collect()}
    assert len(got) == 7 * len(shares) and all(got["empty", s] is None for s in shares)
    for k in values.keys() - {"far", "ends"}:
        assert all(math.isclose(got[k, s], float(np.quantile(values[k], s)), rel_tol=1e-12) for s in shares)
    assert got["far", 0.5] == 1e-300 and got["ends", 0.0] == -math.inf and got["ends", 1.0] == math.inf and got["ends", 0.5] == 0.5


def test_quantiles_without_groups_or_rows(spark):
    df = spark.range(1001).selectExpr("id * 1.0 AS v")
    assert {(r["share"], r["value"]) for r in ranks.quantiles(df, [], "v", (0.5, 0.25)).collect()} == {(0.5, 500.0), (0.25, 250.0)}
    assert ranks.quantiles(df.limit(0), [], "v", (0.5,)).collect() == []
    row = ranks.quantile_table(df, [], "v", {"median": 0.5, "top": 1.0}).first()
    assert (row["median"], row["top"]) == (500.0, 1000.0)


def test_reports(spark):
    data = [("a", float(k), k % 3) for k in range(90)] + [("b", 4.0, 0), ("b", 6.0, 0), ("c", 1.0, None)]
    df = spark.createDataFrame(data, "case string, value double, label long")
    report = ranks.image_report(df, more={"total": F.sum("value"), "median": F.max("value")})
    got = {(r["case"], r["part"], r["label"]): r for r in report.collect()}
    own = np.array([v for c, v, k in data if c == "a" and k > 0])
    r = got["a", "foreground", None]
    assert r["voxels"] == 60 and math.isclose(r["share"], 2 / 3) and r["total"] == own.sum() and r["median"] == own.max()
    assert math.isclose(r["percentile_10_0"], np.percentile(own, 10)) and math.isclose(r["stdev"], own.std())
    assert got["b", "foreground", None]["mean"] == 0.0 and got["b", "label", 0]["mean"] == 5.0
    assert ("c", "label", None) not in got and got["c", "image", None]["max"] == 1.0
    s = {(r["part"], r["label"]): r for r in ranks.report_summary(report, overrides={"voxels": F.sum}).collect()}
    assert s["image", None]["max"] == 89.0 and s["image", None]["voxels"] == 93 and s["image", None]["cases"] == 3


# -- suppression -----------------------------------------------------------------


def kept_by_hand(rows, bar):
    left, out = sorted(rows, key=lambda r: (-(r[2] if r[2] is not None else -math.inf), r[1])), []

    def iou(a, b):
        inter = np.prod([max(0.0, min(a[i + 1], b[i + 1]) - max(a[i], b[i])) for i in (3, 5)])
        size = lambda r: (r[4] - r[3]) * (r[6] - r[5])
        return inter / max(size(a) + size(b) - inter, 1e-12)

    for r in left:
        if all(r[0] != o[0] or iou(r, o) <= bar for o in out):
            out.append(r)
    return {r[:2] for r in out}


BOXES = "g long, box_id long, score double, x0 double, x1 double, y0 double, y1 double"


@pytest.mark.parametrize("bar", [0.1, 0.6])
def test_boxes_of_very_unlike_sizes_in_a_hot_group(spark, bar):
    rng = np.random.default_rng(12)
    data = []
    for k in range(110):
        w, h = 10.0 ** rng.uniform(-2, 3, 2) if k % 4 == 0 else rng.uniform(3, 6, 2)
        x, y = rng.uniform(-20, 20, 2)
        data.append((0 if k % 5 else k, k, float(rng.integers(0, 9)), float(x), float(x + w), float(y), float(y + h)))
    data += [(0, 900 + k, 1.0, 2.0, 2.0, 0.0, 5.0) for k in range(2)] + [(0, 950, None, -3.0, 3.0, -3.0, 3.0)]
    df = spark.createDataFrame(data, BOXES).selectExpr("*", "'x' AS m", "1 AS n").repartition(4)
    got = suppression.suppressed(df, "g", bar)
    assert got.columns == df.columns
    assert sorted((r["g"], r["box_id"]) for r in got.collect()) == sorted(kept_by_hand(data, bar))


def test_equal_boxes_and_none(spark):
    df = spark.createDataFrame([(1, 5, 0.5, 0.0, 1.0, 0.0, 1.0)] * 4 + [(None, 5, 0.5, 0.0, 1.0, 0.0, 1.0)] * 2, BOXES)
    assert sorted((r["g"] or 0) for r in suppression.suppressed(df, "g", 0.5).collect()) == [0, 1]
    assert suppression.suppressed(df.limit(0), "g", 0.5).collect() == []
    with pytest.raises(ValueError):
        suppression.suppressed(df, "g", 1.0)


def peaks_by_hand(rows, least, radius):
    out, alive = set(), {r[:3]: r[3] for r in rows if r[3] > least}
    while alive:
        case, x, y = best = min(alive, key=lambda p: (-alive[p], *p))
        out.add((*best, alive[best]))
        alive = {p: v for p, v in alive.items() if p[0] != case or abs(p[1] - x) > radius or abs(p[2] - y) > radius}
    return out


def test_peaks_of_the_query_are_those_of_brute_force(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").toPandas()
    top = li.assign(x=li.l_partkey % 40, y=li.l_quantity.astype(int)).groupby(["l_suppkey", "x", "y"]).l_discount.max()
    got = [tuple(r) for r in grids.peaks(spark, sf_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == peaks_by_hand([(*map(int, k), float(v)) for k, v in top.items()], 0.05, 5)


# -- drawn transforms and masks --------------------------------------------------


def test_random_plans_are_affine_about_the_centre(spark):
    cases = spark.createDataFrame([(f"c{k}",) for k in range(60)], "case string")
    plan = resample.random_plans(cases, (9, 7, 5), (5, 7, 9), 3, 0.5, 0.4, (0.5, 2.0), (1.0, 0.0, 0.0))
    same = 0
    for r in plan.collect():
        m = np.array(r["matrix"]).reshape(3, 4)
        scale = np.cbrt(np.linalg.det(m[:, :3]))
        turn = m[:, :3] / scale
        assert np.allclose(turn @ turn.T, np.eye(3)) and 0.5 <= 1 / scale <= 2 and abs(np.arctan2(turn[1, 0], turn[0, 0])) <= 0.4
        centre = m @ [2, 3, 4, 1] - [4, 3, 2]
        assert abs(centre[0]) <= 1 and np.allclose(centre[1:], 0)
        same += np.allclose(m[:, :3], np.eye(3)) and abs(centre[0]) < 1e-12
    assert 15 <= same <= 45
    again = {r["case"]: r["matrix"] for r in resample.random_plans(cases.repartition(7), (9, 7, 5), (5, 7, 9), 3, 0.5, 0.4, (0.5, 2.0), (1.0, 0.0, 0.0)).collect()}
    assert again == {r["case"]: r["matrix"] for r in plan.collect()}


def test_smooth_fields_lie_between_their_corners(spark):
    df = frame(spark, rows("a", np.ones((5, 5, 3))))
    f = array(resample.smooth_field(df, (2, 3, 1), (5, 5, 3), 1, 2.0, 4.0), "a", (5, 5, 3))
    assert f.min() >= 2 and f.max() <= 4 and np.allclose(f[2], (f[0] + f[4]) / 2) and np.allclose(f[:, 1], (f[:, 0] + f[:, 2]) / 2)
    assert np.allclose(array(resample.field_adjusted(df, resample.smooth_field(df, (2, 3, 1), (5, 5, 3), 1, 2.0, 4.0)), "a", (5, 5, 3)), f)


def test_sobel_gradients(spark):
    a = np.random.default_rng(13).normal(size=(5, 4, 6))
    got = stencils.sobel_gradients(frame(spark, rows("a", a)), a.shape)
    for k, axis in enumerate("xyz"):
        want = a
        for j in range(3):
            want = along(want, [-0.5, 0, 0.5] if j == k else [0.25, 0.5, 0.25], j, "repeat")
        assert np.allclose(array(got, "a", a.shape, f"g_{axis}"), want)


def test_thresholds_between_two_classes(spark):
    rng = np.random.default_rng(14)
    low, high = rng.normal(0, 0.3, 200), rng.normal(5, 0.3, 100)
    data = [("a", k, 0, 0, float(v)) for k, v in enumerate(np.r_[low, high])] + [("flat", k, 0, 0, 1.0) for k in range(4)] + [("a", 900, 0, 0, None), ("a", 901, 0, 0, math.nan)]
    df = frame(spark, data)
    t = {r["case"]: r["threshold"] for r in voxels.otsu_thresholds(df).collect()}
    counts, edges = np.histogram(np.r_[low, high], 256)
    c = (edges[1:] + edges[:-1]) / 2
    w0, w1 = np.cumsum(counts)[:-1], np.cumsum(counts[::-1])[::-1][1:]
    m0, m1 = np.cumsum(counts * c)[:-1] / w0, np.cumsum((counts * c)[::-1])[::-1][1:] / w1
    best = w0 * w1 * (m0 - m1) ** 2
    assert t["flat"] is None and best[np.argmin(np.abs(c[:-1] - t["a"]))] > 0.999 * best.max()
    mask = {r["x"]: r["value"] for r in voxels.foreground_mask(df).where("case = 'a'").collect()}
    assert [mask[k] for k in range(300)] == [1.0] * 200 + [0.0] * 100


def test_lines_through_points_and_waves(spark):
    df = frame(spark, [("a", k, 0, 0, float(k)) for k in range(-3, 9)])
    got = {r["x"]: r["value"] for r in voxels.remapped(df, [(0, 1.0), (2, 5.0), (6, 4.0)]).collect()}
    assert all(math.isclose(got[k], np.interp(k, [0, 2, 6], [1, 5, 4])) for k in got)
    df = spark.createDataFrame([(1, [0.0] * 8), (2, []), (3, None)], "k long, s array<double>")
    got = {r["k"]: r["s"] for r in df.select("k", voxels.signal_wave(F.col("s"), 2.0, 1.0, True, 0.5, 0.25).alias("s")).collect()}
    assert got[1][:4] == [0.0] * 4 and got[1][5:] == [-2.0, 0.0, 0.0] and got[2] == [] and got[3] is None
    got = df.where("k = 1").select(voxels.signal_drop(voxels.signal_wave(F.col("s"), 1.0, 2.0), 0.25, 0.5).alias("s")).first()["s"]
    assert np.allclose(got, np.where((np.arange(8) >= 2) & (np.arange(8) < 6), 0, np.sin(2 * np.pi * 2 * np.arange(8) / 8)))


def test_contours_and_boundaries_make_no_rows_of_neighbours(spark):
    rng = np.random.default_rng(8)
    a = (rng.random((9, 8, 7)) < 0.9).astype(float)
    df = frame(spark, rows("a", a)).where("value > 0")
    full = np.pad(a, 1)
    cube = np.min([full[i : i + 9, j : j + 8, k : k + 7] for i in range(3) for j in range(3) for k in range(3)], axis=0)
    cross = np.min([full[i : i + 9, j : j + 8, k : k + 7] for i, j, k in ((0, 1, 1), (2, 1, 1), (1, 0, 1), (1, 2, 1), (1, 1, 0), (1, 1, 2))], axis=0)
    for found, inside in ((stencils.contour(df), cube), (instances.boundary(df, ["case"]), cross)):
        assert "Generate" not in found._jdf.queryExecution().toString()
        got = sorted((r["x"], r["y"], r["z"]) for r in found.collect())
        assert got == sorted(map(tuple, np.argwhere((a > 0) & (inside == 0)).tolist())) and 0 < len(got) < a.sum()
    twice = instances.boundary(df.union(df), ["case"])  # a voxel that stands twice has the same neighbours
    assert twice.distinct().count() == ((a > 0) & (cross == 0)).sum() and twice.count() == 2 * twice.distinct().count()


@pytest.mark.parametrize("listed", [0, 20, 256])
def test_boxes_of_small_groups_come_together_once(spark, listed, monkeypatch):
    rng = np.random.default_rng(3)
    data = []
    for k in range(240):
        w, h = rng.uniform(3, 6, 2)
        x, y = rng.uniform(-8, 8, 2)
        data.append((0 if k % 3 == 0 else k // 12, k, float(rng.integers(0, 5)), float(x), float(x + w), float(y), float(y + h)))
    df = spark.createDataFrame(data, BOXES).selectExpr("*", "map('k', box_id) AS m")
    rounds = []
    monkeypatch.setattr(suppression, "_in_rounds", lambda *a, f=suppression._in_rounds: rounds.append(a) or f(*a))
    got = suppression.suppressed(df, "g", 0.3, listed=listed)
    assert got.columns == df.columns and bool(rounds) == (listed < 80)
    rows_ = got.collect()
    assert sorted((r["g"], r["box_id"]) for r in rows_) == sorted(kept_by_hand(data, 0.3)) and all(r["m"] == {"k": r["box_id"]} for r in rows_)


@pytest.mark.parametrize("batched", [0, 100, 1 << 14])
def test_peaks_of_small_cases_come_together_once(spark, batched, monkeypatch):
    rng = np.random.default_rng(5)
    places = {(c, *p) for c in range(6) for p in rng.integers(0, 14, (200 if c == 2 else 40, 2)).tolist()}
    data = [(*p, float(rng.integers(0, 6))) for p in sorted(places)]
    df = spark.createDataFrame([*data, (None, 0, 0, 9.0)], "case long, x long, y long, value double")
    rounds = []
    monkeypatch.setattr(suppression, "_peaks_in_rounds", lambda *a, f=suppression._peaks_in_rounds: rounds.append(a) or f(*a))
    got = [tuple(r) for r in suppression.probability_peaks(df, 0.5, 2, batched=batched).collect()]
    assert bool(rounds) == (batched <= 100) and len(got) == len(set(got)) and set(got) == peaks_by_hand(data, 0.5, 2)
    assert suppression.probability_peaks(df.limit(0), 0.5, 2).collect() == []


@pytest.mark.parametrize("mode", ["linear", "nearest"])
@pytest.mark.parametrize("align", [False, True])
def test_resizing_sums_before_it_shuffles(spark, mode, align):
    rng = np.random.default_rng(6)
    df = frame(spark, rows("a", rng.random((4, 3, 2))) + rows("b", rng.random((4, 3, 2))))
    df = df.union(df.limit(5)).withColumn("value", F.when(F.col("x") + F.col("y") != 2, F.col("value")))  # repeated, null
    shape, size = (4, 3, 2), (7, 3, 5)
    got = resample.resized(df, shape, size, mode, align)
    assert "SortMergeJoin" not in got._jdf.queryExecution().toString()
    want = resample.resampled(df, resample.one_plan(df, shape, size, resample.zoom_matrix(shape, size, align)), mode)
    a, b = ({tuple(r)[:4]: r["value"] for r in d.collect()} for d in (got, want))
    assert a.keys() == b.keys() and len(a) == 2 * 7 * 3 * 5 and all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)
    assert resample.resized(df.limit(0), shape, size).collect() == []
