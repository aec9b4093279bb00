"""Running totals, draws, scores, numbers as text, late streams and connectors against plain Python."""

import gzip
import math
import os
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scanloom.functions import scalars
from scanloom.operators import crops, joins, metrics
from scanloom.plans import samples
from scanloom.sources import connectors, tables, volumes
from scanloom.streaming import streams


def test_running_totals_of_groups(spark):
    rng = random.Random(0)
    data = [(rng.choice(["a", "b", None]), k, rng.randint(0, 9)) for k in range(500)] + [("hot", k, 1) for k in range(900)]
    df = spark.createDataFrame(data, "g string, k long, n long").repartition(7)
    want, so_far = {}, {}
    for g, k, n in sorted(data, key=lambda r: r[1]):
        so_far[g] = so_far.get(g, 0) + n
        want[g, k] = so_far[g]
    got = joins.running_totals(df, ["k"], ["n"], ["g"])
    assert got.columns == ["g", "k", "n", "total_n"]
    assert {(r["g"], r["k"]): r["total_n"] for r in got.collect()} == want and got.count() == len(data)


# -- draws -----------------------------------------------------------------------


def test_weighted_places_are_those_of_prefix_sums(spark, monkeypatch):
    rng = np.random.default_rng(1)
    w = rng.integers(0, 5, (6, 5, 4)).astype(float)
    w[2, 2, 2] = 5000.0  # one voxel has nearly all
    data = [("a", *map(int, p), float(w[p])) for p in np.ndindex(w.shape)]
    data += [("none", 0, 0, z, 0.0) for z in range(4)] + [("odd", 0, 0, 0, None), ("odd", 0, 0, 1, -3.0), ("odd", 0, 0, 2, math.nan), ("odd", 0, 0, 3, 1.0)]
    df = spark.createDataFrame(data, "case string, x long, y long, z long, weight double").selectExpr("*", "1 AS w", "2 AS total", "3 AS bin")
    for bins, parts in ((1024, 1), (7, 5)):
        monkeypatch.setattr(crops, "BINS", bins)
        got = {(r["case"], r["sample"]): (r["x"], r["y"], r["z"]) for r in crops.weighted_places(df.repartition(parts), 40, 3).collect()}
        assert len(got) == 120 and {v for (c, _), v in got.items() if c == "odd"} == {(0, 0, 3)}
        u = {(r["case"], r["sample"]): r["u"] for r in crops._draws(df, 40, 3).collect()}
        ends = np.cumsum(w.reshape(-1))
        for k in range(40):
            assert got["a", k] == np.unravel_index(np.searchsorted(ends, u["a", k] * ends[-1], side="right"), w.shape)
            assert got["none", k] == (0, 0, int(u["none", k] * 4))
    assert crops.weighted_places(df.limit(0), 3, 1).collect() == []


def test_weighted_crops_fit(spark):
    df = spark.createDataFrame([("a", x, y, 0, float(x == 1) + float(x == 7)) for x in range(9) for y in range(3)], "case string, x long, y long, z long, weight double")
    got = crops.weighted_crops(df, (9, 3, 1), (4, 3, 2), 30, 5).collect()
    assert len(got) == 30 and all(0 <= r["x0"] <= 5 and r["y0"] == 0 and r["z0"] == 0 for r in got)
    assert len({r["x0"] for r in got}) > 1  # no voxel with a weight can be a centre, so all centres are alike


def test_random_rows_and_twins(spark, sf_dir):
    df = spark.createDataFrame([(c, k, f"v{k}") for c in range(300) for k in range(4)], "case long, k long, v string")
    got = crops.random_rows(df, "k", 0.25, 9).collect()
    assert 45 < len(got) < 105 and len({r["case"] for r in got}) == len(got) and {r["k"] for r in got} == {0, 1, 2, 3}
    assert sorted(map(tuple, got)) == sorted(map(tuple, crops.random_rows(df.repartition(9), "k", 0.25, 9).collect()))
    # Each case of the query is one of the plain transforms of its own volume, by one coefficient.
    before, after = {}, {}
    for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(40).collect():
        before[r["vec_id"]] = np.array(r["embedding"], np.float64).reshape(4, 4, 4)
        after[r["vec_id"]] = np.full((4, 4, 4), np.nan)
    for r in samples.random_twins(spark, sf_dir).where(F.col("case").isin(list(before))).collect():
        after[r["case"]][r["x"], r["y"], r["z"]] = r["value"]
    moves, kinds = [lambda v: v, lambda v: v[::-1], lambda v: v[:, ::-1], lambda v: np.rot90(v)], set()
    for k, v in before.items():
        fits = []
        for i, move in enumerate(moves):
            a = np.stack([move(v).reshape(-1), np.ones(64)], axis=1)
            (scale, shift), rest, *_ = np.linalg.lstsq(a, after[k].reshape(-1), rcond=None)
            if rest.size and rest[0] < 1e-18 and 0.5 <= scale <= 1.5 and abs(shift) <= 0.15:
                fits.append((i, round(scale, 9) == 1, abs(shift) < 1e-9))
        assert len(fits) == 1
        kinds |= set(fits)
    assert {i for i, *_ in kinds} == {0, 1, 2, 3} and len({k[1:] for k in kinds}) >= 3


# -- scores ----------------------------------------------------------------------


def test_averages_of_areas(spark):
    df = spark.createDataFrame([("a", True, 0.9), ("a", False, 0.1), ("b", True, 0.2), ("b", True, 0.6), ("b", False, 0.4)], "c string, t boolean, s double")
    area = lambda how, d=df: metrics.averaged_auc(d, "c", F.col("t"), "s", how).first()["auc"]
    assert math.isclose(area("macro"), 0.75) and math.isclose(area("weighted"), (1 + 2 * 0.5) / 3) and math.isclose(area("micro"), 5 / 6)
    assert {(r["c"], r["auc"]) for r in metrics.averaged_auc(df, "c", F.col("t"), "s", "none").collect()} == {("a", 1.0), ("b", 0.5)}
    one_sided = df.union(spark.createDataFrame([("c", True, 0.5)], df.schema))
    assert area("macro", one_sided) is None
    with pytest.raises(ValueError):
        metrics.averaged_auc(df, "c", F.col("t"), "s", "median")


@pytest.mark.parametrize("weights", ["simple", "square", "uniform"])
def test_generalized_dice(spark, weights):
    rng = np.random.default_rng(2)
    data, want = [], {}
    for case in range(6):
        t, p = (rng.random((2, 4, 20)) < 0.3).astype(int)
        if case == 1:
            t[2] = 0  # not in the truth
        if case in (2, 3):
            t[:] = 0
        if case == 2:
            p[:] = 0
        data += [(case, c, int(a), int(b)) for c in range(4) for a, b in zip(t[c], p[c])]
        with np.errstate(divide="ignore", invalid="ignore"):
            size = t.sum(1).astype(float)
            w = {"simple": 1 / size, "square": 1 / size**2, "uniform": np.ones(4)}[weights]
        w[np.isinf(w)] = 0
        w = np.where(size == 0, w.max(), w) if weights != "uniform" else w
        low = (w * (t.sum(1) + p.sum(1))).sum()
        want[case] = 2 * (w * (t * p).sum(1)).sum() / low if low else float(p.sum() == 0)
    df = spark.createDataFrame(data, "case long, label long, t int, p int")
    got = {r["case"]: r["dice"] for r in metrics.generalized_dice(df, "case", "label", "t", "p", weights).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)


def test_short_numbers(spark):
    rng = random.Random(3)
    values = [0.0, 1.0, -1.0, 100000.0, 999999.5, 1e6, 123456789.0, 1e-4, 0.00012345678, 9.9999999e-5, 1e100, -1e-300, math.inf, -math.inf, math.nan, 0.1 + 0.2]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 12) for _ in range(400)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)] + [(-1, None)], "k long, v double")
    got = {r["k"]: r["t"] for r in df.select("k", scalars.short_number("v").alias("t")).collect()}
    assert got.pop(-1) is None and got == {k: f"{v:.6g}" for k, v in enumerate(values)}
    row = spark.createDataFrame([([1.5, None, 2.0],)], "a array<double>").select(scalars.joined_numbers(F.col("a"), ",").alias("t")).first()
    assert row["t"] == "1.5,2"


def test_readable_bytes_of_a_binary_value(spark):
    values = [0, 1023, 1024, 1126, 1280, 1792, 256 * 1024 + 52429, 2**40, 5 * 2**50 + 7, 37 * 172385**2]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long")
    for units in (("B", "KB", "MB", "GB", "TB"), ("B", "KB", "MB", "GB")):
        want = {None: None}
        for v in values:
            k = next((k for k in range(len(units)) if v < 1024 ** (k + 1)), len(units) - 1)
            want[v] = f"{v / 1024**k:.1f} {units[k]}"
        assert {r["v"]: r["t"] for r in df.select("v", scalars.readable_bytes("v", units).alias("t")).collect()} == want


def test_short_numbers_that_tie_in_decimal(spark):
    values = [-0.0, 0.5000005, 1.000005, 1.000015, 2.000025, 123456.5, 123457.5, 1.000005e-7, 1.000035e12]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v double")
    got = {r["k"]: (r["t"], r["j"]) for r in df.select("k", scalars.short_number("v").alias("t"), scalars.joined_numbers(F.array("v", -F.col("v"))).alias("j")).collect()}
    assert got == {k: (f"{v:.6g}", f"{v:.6g};{-v:.6g}") for k, v in enumerate(values)}
    assert spark.createDataFrame([(None,)], "a array<double>").select(scalars.joined_numbers(F.col("a")).alias("t")).first()["t"] is None


def test_fixed_decimals_that_tie(spark):
    values = [0.4991010545045, 0.7724573048975, 0.1332629925235, 0.5, 0.125, 1e-13, -0.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").coalesce(1)
    assert [r["t"] for r in df.select(scalars.formatted("v", ".12f").alias("t")).collect()] == [*(f"{v:.12f}" for v in values), None]


@settings(max_examples=60)
@given(st.sampled_from(sorted(scalars.PREFIXES)), st.sampled_from(sorted(scalars.PREFIXES)), st.sampled_from(scalars.QUANTITIES))
def test_units(a, b, base):
    assert math.isclose(scalars.unit_factor(a + base, b + base), 10.0 ** (scalars.PREFIXES[a] - scalars.PREFIXES[b]))


def test_imperial_and_unlike_units():
    assert math.isclose(scalars.unit_factor("Mile", "kilometer"), 1.609344) and math.isclose(scalars.unit_factor("yard", "foot"), 3)
    for a, b in (("meter", "byte"), ("parsec", "meter"), ("nonsensemeter", "meter")):
        with pytest.raises(ValueError):
            scalars.unit_factor(a, b)


def test_points_in_boxes_on_all_axes(spark):
    rng = random.Random(4)
    boxes = [(g, k, x, x + rng.choice([0.5, 3, 40]), y, y + rng.uniform(0, 9)) for k in range(60) for g, x, y in [(rng.choice("ab"), rng.uniform(-20, 20), rng.uniform(-20, 20))]] + [("a", 99, 3.0, 1.0, 0.0, 1.0)]
    points = [(rng.choice("ab"), k, rng.uniform(-20, 20), rng.uniform(-20, 20)) for k in range(200)] + [("a", 900, boxes[0][2], boxes[0][4])]
    b = spark.createDataFrame(boxes, "g string, id long, x0 double, x1 double, y0 double, y1 double")
    p = spark.createDataFrame(points, "g string, id long, x double, y double")
    got = [(r["point_id"], r["box_id"]) for r in joins.points_in_boxes(p, b, "g", 4.0, ("x", "y")).collect()]
    want = {(i, j) for g, i, x, y in points for h, j, x0, x1, y0, y1 in boxes if g == h and x0 <= x <= x1 and y0 <= y <= y1}
    assert len(got) == len(want) and set(got) == want


# -- streams ---------------------------------------------------------------------


def test_rows_are_dealt_in_turn(spark):
    df = spark.createDataFrame([(10 * k,) for k in range(23)], "id long").repartition(4)
    assert [sorted(r["id"] // 10 for r in streams.sharded(df, "id", k, 3).collect()) for k in range(3)] == [list(range(k, 23, 3)) for k in range(3)]


def test_a_buffer_holds_rows_back_by_less_than_its_size(spark):
    df = spark.range(2000).repartition(5)
    place = {r["id"]: r["place"] for r in streams.epoch_places(df, "id", 1, 0, 64).collect()}
    assert sorted(place.values()) == list(range(2000))
    assert all(abs(p - k) < 64 for k, p in place.items()) and sum(p != k for k, p in place.items()) > 1500
    assert place != {r["id"]: r["place"] for r in streams.epoch_places(df, "id", 1, 1, 64).collect()}


def test_late_rows_and_closed_sessions(spark, tmp_path):
    at = lambda m: pd.Timestamp("2024-01-01", tz="UTC") + pd.Timedelta(minutes=m)
    rows = [(0, "a", 0), (0, "a", 4), (0, "b", 9), (1, "a", 60), (1, "a", 3), (1, "b", 12), (2, "a", 64), (2, "b", 13), (2, "a", 61), (2, "b", 200)]
    df = spark.createDataFrame([(c, k, at(m).to_pydatetime()) for c, k, m in rows], "chunk int, k string, ts timestamp")
    folder = f"file://{tmp_path}/sessions"
    query = lambda s: streams.closed_sessions(s, "ts", "k", "10 minutes", "15 minutes")
    dropped = streams.replayed(df, "chunk", folder, query, streams.append_log(f"{folder}/log"))
    got = {(r["k"], r["start"], r["end"], r["n"]) for r in spark.read.parquet(f"{folder}/log").collect()}
    naive = lambda m: at(m).to_pydatetime().replace(tzinfo=None)
    # After the second chunk the mark stands at minute 45, so minute 13 comes too late; b's last session stays open.
    assert got == {("a", naive(0), naive(14), 3), ("b", naive(9), naive(22), 2), ("a", naive(60), naive(74), 3)}
    assert dropped == 1


# -- connectors ------------------------------------------------------------------


def test_headers_without_voxels(spark, tmp_path):
    """A file of which only the first bytes are there has its header all the same."""
    affine = np.diag([1.5, 2, 3, 1])
    whole = volumes.write_nifti(np.zeros((30, 20, 10), np.int16), affine)
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.nii").write_bytes(whole[: volumes.HEADER_BYTES])
    (tmp_path / "sub" / "b.nii.gz").write_bytes(gzip.compress(whole))
    (tmp_path / "c.nii").write_bytes(b"broken")
    (tmp_path / "d.txt").write_bytes(b"not asked for")
    got = {os.path.basename(r["path"]): r for r in connectors.volume_headers(spark, f"file://{tmp_path}", files_per_task=1).collect()}
    assert set(got) == {"a.nii", "b.nii.gz", "c.nii"}
    for f in ("a.nii", "b.nii.gz"):
        assert (got[f]["shape"], got[f]["spacing"], got[f]["dtype"], got[f]["error"]) == ([30, 20, 10], [1.5, 2.0, 3.0], "int16", None)
        assert got[f]["affine_hash"] == volumes.affine_hash(affine)
    assert "ValueError" in got["c.nii"]["error"] and got["c.nii"]["shape"] is None
    files = volumes.binary_files(spark, str(tmp_path), "b.nii.gz")
    assert volumes.headers(files).first()["affine_hash"] == volumes.affine_hash(affine)
    (tmp_path / "none").mkdir()
    assert connectors.volume_headers(spark, f"{tmp_path}/none").collect() == []
    with pytest.raises(ValueError):
        connectors.mounted("s3://bucket/x")


def test_a_table_is_replaced_as_a_whole(spark, tmp_path):
    folder, schema = str(tmp_path / "t"), "k long, v string, ok boolean"
    read = lambda f: sorted(map(tuple, spark.read.schema(schema).option("header", "true").csv(f).collect()))
    first, second = [(1, 'a "quoted", one', True), (2, None, False)], [(3, "c", None)]
    connectors.write_whole(spark.createDataFrame(first, schema).repartition(3), folder)
    assert read(folder) == first and not os.path.exists(f"{folder}.bak")
    connectors.write_whole(spark.createDataFrame(second, schema), folder)
    assert read(folder) == second and read(f"{folder}.bak") == first
    broken = spark.range(8).repartition(4).selectExpr("id AS k", "CASE WHEN id = 5 THEN raise_error('no') ELSE 'x' END AS v", "true AS ok")
    with pytest.raises(Exception):
        connectors.write_whole(broken, folder)
    assert read(folder) == second and read(f"{folder}.bak") == first
    assert sorted(os.listdir(tmp_path)) == ["t", "t.bak"]  # nothing of the failed one is left
    new = connectors.rewrite_column(spark, folder, schema, "k", "v", spark.createDataFrame([(3, "z"), (3, "y"), (9, "w")], "k long, v string"))
    assert sorted(map(tuple, new.collect())) == [(3, "y", None)] and read(f"{folder}.bak") == second


def test_report_files(spark, tmp_path):
    raw = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", math.nan), ("b", "y", 5.0)], "case string, class string, value double")
    tables.write_report(raw, str(tmp_path / "r"), "dice")
    back = lambda part: spark.read.option("header", "true").csv(str(tmp_path / "r" / f"dice_{part}")).collect()
    summary = {r["class"]: r for r in back("summary")}
    assert set(summary) == {"x", "y", "mean"} and float(summary["mean"]["mean"]) == 3.5 and summary["x"]["notnans"] == "1"
    assert float(back("overall")[0]["dice"]) == 3.5 and len(back("raw")) == 6


def test_boxes_of_all_sizes_overlap(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), k, x, x + w, y, y + h) for k in range(150) for x, y in [(rng.uniform(-50, 50), rng.uniform(-50, 50))] for w, h in [(10 ** rng.uniform(-2, 4), 10 ** rng.uniform(-2, 2))]]
    df = spark.createDataFrame([*rows, ("a", 999, None, 1.0, 0.0, 1.0)], "g string, i long, x0 double, x1 double, y0 double, y1 double")
    got = {(r["a_i"], r["b_i"]): r["inter"] for r in joins.box_overlap(df, df, "g", 4.0, ("x", "y")).collect()}
    want = {}
    for p in rows:
        for q in rows:
            inter = max(0.0, min(p[3], q[3]) - max(p[2], q[2])) * max(0.0, min(p[5], q[5]) - max(p[4], q[4]))
            if p[0] == q[0] and inter > 0:
                want[p[1], q[1]] = inter
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    assert joins.box_overlap(df.limit(0), df, "g", 4.0, ("x", "y")).collect() == []


def test_texts_that_hold_a_needle(spark):
    texts = ["abc", "xabcx", "ab", None, "", "zz", "bcd", "ünder", "aaaa", "abc"]
    needles = ["abc", "ün", "aaaaa", "", None, "zz", "q"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    asked = spark.createDataFrame([(n,) for n in needles], "n string")
    holds = {k for k, t in enumerate(texts) if t and any(n and n in t for n in needles)}
    assert {r["k"] for r in joins.containing(rows, "t", asked, "n", keep=True).collect()} == holds
    assert {r["k"] for r in joins.containing(rows, "t", asked, "n").collect()} == set(range(len(texts))) - holds
    assert joins.containing(rows, "t", asked.limit(0), "n").count() == len(texts)


def test_rank_of_a_value(spark):
    from scanloom.operators import ranks, windows

    values = [random.Random(8).choice([0.5, 1.5, 1e-9, -3.0]) for _ in range(200)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v double")
    for rank in (0, 17, 100, 199):
        value = sorted(values)[rank]
        assert ranks.nth(df, "v", rank) == (value, sum(v < value for v in values))
    with pytest.raises(ValueError):
        ranks.nth(df, "v", 200)
    for share, n in ((0.0, 0), (0.25, 50), (1.0, 200)):
        assert windows.hash_split(df, "k", 3, share).where("split = 'val'").count() == n
    assert windows.hash_split(df.limit(0), "k", 3, 0.5).collect() == []


def test_registries_and_overlays(spark):
    base = tables.yaml_records(spark, "a:\n  x: 1\n  y: u\nb:\n  y: v\n", "x long, y string")
    assert sorted(map(tuple, base.collect())) == [("a", 1, "u"), ("b", None, "v")]
    runs = spark.createDataFrame([(1, "a", None, "w"), (2, "a", 5, None), (3, "c", None, "z"), (4, None, None, None)], "run long, name string, x long, y string")
    assert sorted((r["run"], r["x"], r["y"]) for r in tables.overlaid(base, runs, "name").collect()) == [(1, 1, "w"), (2, 5, "u"), (3, None, "z"), (4, None, None)]
    for text in ("- a\n- b\n", "a: 3\n", "a:\n  z: 1\n"):
        with pytest.raises(ValueError):
            tables.yaml_records(spark, text, "x long, y string")
    assert tables.yaml_records(spark, "", "x long").collect() == []


def test_a_doubled_lookup_adds_no_rows(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, c string")
    table = spark.createDataFrame([("a", 9, "x"), ("a", 5, "y"), ("b", None, "z"), (None, 1, "n")], "id string, v long, w string")
    got = sorted(map(tuple, joins.lookups(base, [(table, "id", "c")]).select("k", "v", "w").collect()))
    assert got == [(1, 5, "y"), (2, None, "z"), (3, None, None)]
    assert joins.one_row(base.select("c"), "c").count() == 3


def test_what_was_written_can_be_forgotten(spark):
    from scanloom.sources import shared

    folder = shared.fresh_folder(spark, "test")
    spark.range(3).write.parquet(folder)
    assert folder.startswith(shared.shared_dir(spark)) and spark.sparkContext.applicationId in folder
    assert shared.fresh_folder(spark, "test") != folder and os.path.isdir(folder.removeprefix("file://"))
    shared.forget(spark)
    shared.forget(spark)  # nothing is there any more
    assert not os.path.exists(folder.removeprefix("file://"))
