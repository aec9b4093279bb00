import hashlib
import json
import math
from itertools import product

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scanloom.operators import audit, fields, instances, joins, lesions, metrics, sets, suppression, voxels, windows
from scanloom.functions import scalars


def brute_components(points, reach):
    todo, groups = set(points), []
    while todo:
        stack, own = [min(todo)], set()
        while stack:
            p = stack.pop()
            if p in todo:
                todo.discard(p)
                own.add(p)
                stack += [q for q in todo if max(abs(a - b) for a, b in zip(p, q)) <= 1 and sum(abs(a - b) for a, b in zip(p, q)) <= reach]
        groups.append(frozenset(own))
    return set(groups)


@given(st.sets(st.tuples(*[st.integers(-3, 3)] * 3), max_size=60), st.sampled_from([(6, 1), (18, 2), (26, 3)]))
@settings(max_examples=80, deadline=None)
def test_components_are_those_of_a_flood_fill(points, kind):
    pts = sorted(points)
    label = instances.component_labels(np.array(pts, np.int64).reshape(-1, 3), kind[0])
    got = {frozenset(p for p, k in zip(pts, label) if k == c) for c in set(label.tolist())}
    assert got == brute_components(pts, kind[1])


def test_matching_strategies_differ_as_they_should():
    pairs = pd.DataFrame({"pred": [1, 1, 2], "truth": [10, 11, 10], "iou": [0.6, 0.5, 0.9]})
    assert sorted(instances.greedy_global(pairs)) == [1, 2]
    assert instances.greedy_by_prediction(pairs) == [0]
    chain = pd.DataFrame({"pred": [1, 1, 2], "truth": [10, 11, 10], "iou": [0.9, 0.2, 0.8]})
    assert instances.greedy_global(chain) == [0]
    assert len(instances.maximal(chain)) == 2


def test_components_and_matches_of_many_cases_at_a_time(spark):
    rng = np.random.default_rng(4)
    points = {(c, *p) for c in [None, *range(40)] for p in rng.integers(0, 5, (30 if c != 7 else 300, 3)).tolist()}
    df = spark.createDataFrame(sorted(points, key=str), "case long, x long, y long, z long")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")  # groups end within batches, and one is larger than a batch
    try:
        parts = instances.components(df, ["case"])
        assert "FlatMapGroups" not in parts._jdf.queryExecution().toString()
        got = {}
        for r in parts.collect():
            got.setdefault(r["case"], {})[r["x"], r["y"], r["z"]] = r["component"]
        pairs = [(c, p, t, round(float(v), 3)) for c in range(40) for p in range(6) for t, v in zip(rng.choice(9, 4, False).tolist(), rng.random(4), strict=True)]
        own = spark.createDataFrame(pairs, "case long, pred long, truth long, iou double")
        found = {s: {tuple(r) for r in instances.match(own, 0.2, s).collect()} for s in instances.STRATEGIES}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    for c, own_parts in got.items():
        pts = sorted(p[1:] for p in points if p[0] == c)
        assert [own_parts[p] for p in pts] == instances.component_labels(np.array(pts, np.int64)).tolist() and len(own_parts) == len(pts)
    for s, choose in instances.STRATEGIES.items():
        want = set()
        for c in range(40):
            one = pd.DataFrame([p for p in pairs if p[0] == c and p[3] >= 0.2], columns=["case", "pred", "truth", "iou"])
            want |= {tuple(one.loc[i]) for i in choose(one)}
        assert found[s] == want


def cube(case, lo, hi, value=1.0):
    return [(case, x, y, z, value) for x, y, z in product(range(lo, hi), repeat=3)]


VOX = "case string, x int, y int, z int, value double"


def test_boundary_and_distances(spark):
    a = spark.createDataFrame(cube("a", 0, 5), VOX)
    b = spark.createDataFrame([(c, x + 1, y, z, v) for c, x, y, z, v in cube("a", 0, 5)], VOX)
    edge = instances.boundary(a, ["case"])
    assert edge.count() == 125 - 27
    r = fields.surface_metrics(edge, instances.boundary(b, ["case"])).first()
    assert r["hd"] == 1.0 and r["nsd"] == 1.0 and 0 < r["asd"] < 1
    r = fields.surface_metrics(edge, edge).first()
    assert r["hd"] == 0.0 and r["nsd"] == 1.0
    r = fields.surface_metrics(edge, edge.limit(0)).first()
    assert math.isinf(r["hd"]) and r["nsd"] == 0.0


def test_patches_cover_the_volume(spark):
    starts = instances.patches((10, 7, 4), (4, 4, 4), (3, 3, 3))
    hit = np.zeros((10, 7, 4), bool)
    for x, y, z in starts:
        hit[x : x + 4, y : y + 4, z : z + 4] = True
    assert hit.all()
    grid = instances.patch_grid(spark.createDataFrame([("a", 10, 7, 4)], "case string, nx int, ny int, nz int"), (4, 4, 4), (3, 3, 3))
    assert sorted((r["x0"], r["y0"], r["z0"]) for r in grid.collect()) == sorted(starts)


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["x"], r["y"], r["z"]] = r["value"]
    return out


def test_places_as_in_numpy(spark):
    rng = np.random.default_rng(0)
    shape = (4, 3, 2)
    full = rng.normal(size=shape)
    df = spark.createDataFrame([("a", *map(int, at), float(full[at])) for at in np.ndindex(shape)], VOX)
    assert np.allclose(dense(voxels.flip(df, shape, (0, 2)), shape), np.flip(full, (0, 2)))
    for k in range(4):
        want = np.rot90(full, k)
        assert np.allclose(dense(voxels.rotate90(df, shape, k), want.shape), want)
    assert np.allclose(dense(voxels.transpose(df, (2, 0, 1)), (2, 4, 3)), full.transpose(2, 0, 1))
    assert np.allclose(dense(voxels.zoom_nearest(df, shape, (8, 3, 1)), (8, 3, 1)), full[np.arange(8) // 2][:, :, [0]])
    assert np.allclose(dense(voxels.pad_or_crop(df, shape, (6, 2, 2)), (6, 2, 2))[1:5], full[:, 0:2])
    assert np.allclose(dense(voxels.smooth_mean(df), shape)[1, 1, 0], np.pad(full, 1)[1:4, 1:4, 0:3].sum() / 27)
    once, again = voxels.noise(df, 1.0, 5), voxels.noise(df.repartition(3), 1.0, 5)
    assert np.allclose(dense(once, shape), dense(again, shape))
    assert set(voxels.fill_holes(spark.createDataFrame([r for r in cube("a", 0, 3) if r[1:4] != (1, 1, 1)], VOX), (3, 3, 3)).toPandas()[["x", "y", "z"]].itertuples(index=False, name=None)) == set(product(range(3), repeat=3))
    two = spark.createDataFrame([*cube("a", 0, 2), ("a", 5, 5, 5, 1.0)], VOX)
    assert dense(voxels.largest_component(two, [1]), (6, 6, 6)).sum() == 8
    assert np.allclose(voxels.savitzky_golay(5, 2), np.array([-3, 12, 17, 12, -3]) / 35)
    s = spark.createDataFrame([([1.0, 9.0, 2.0, 3.0],)], "s array<double>").select(voxels.signal_median(F.col("s"), 1).alias("m"), voxels.signal_fill(F.array(F.lit(float("nan")), F.lit(None), F.lit(2.0))).alias("f")).first()
    assert s["m"] == [1.0, 2.0, 3.0, 3.0] and s["f"] == [0.0, 0.0, 2.0]


def lesion(volume, matched, dsc=None, nsd=None, hd=None):
    return {"volume": volume, "is_matched": matched, "sq_dsc": dsc, "sq_nsd": nsd, "sq_hd95": hd}


def test_lesion_documents_to_the_leaderboard(spark):
    doc = {
        "metrics": [
            {"subject_name": "s1", "et": {"tp": 1, "fp": 1, "fn": 1, "reference_instances": [lesion(100, True, 0.8, 0.9, 2.0), lesion(50, False), lesion(5, True, 0.5, 0.5, 1.0), lesion(3, True, None), lesion(None, True, 1.0)]}, "wt": {"fp": 0, "reference_instances": []}},
            {"subject_name": "s2", "et": {"fp": float("nan"), "reference_instances": [lesion(30, True, 0.6, 0.6, float("inf"))]}},
        ],
        "missings": ["s3"],
    }
    docs = spark.createDataFrame([(json.dumps(doc),)], "value string")
    rows = {r["subject"]: r for r in lesions.leaderboard(docs, ["et", "wt"]).collect()}
    assert set(rows) == {"s1", "s2", "s3", "mean", "std", "median"}
    s1 = rows["s1"]
    assert s1["lesionwise_dsc_mean_et"] == pytest.approx(0.8 / 3) and s1["lesionwise_hd95_mean_et"] == pytest.approx((2 + 373 + 373) / 3)
    assert s1["lesionwise_dsc_std_et"] == pytest.approx(np.std([0.8, 0, 0]))
    assert (s1["small_instance_tp_et"], s1["small_instance_fp_et"], s1["small_instance_fn_et"]) == (1, 1, 0)
    assert s1["lesionwise_dsc_mean_wt"] is None and s1["all_instance_f1_et"] == pytest.approx(4 / 6)
    assert rows["s2"]["lesionwise_hd95_mean_et"] == 373 and rows["s3"]["lesionwise_hd95_mean_et"] == 373 and rows["s3"]["lesionwise_dsc_mean_et"] == 0
    assert rows["mean"]["lesionwise_dsc_mean_et"] == pytest.approx((0.8 / 3 + 0.6 + 0) / 3)


def test_roc_and_froc(spark):
    rng = np.random.default_rng(1)
    score, truth = rng.integers(0, 20, 300) / 20, rng.random(300) < 0.4
    df = spark.createDataFrame([("g", float(s), bool(t)) for s, t in zip(score, truth)], "g string, score double, truth boolean")
    wins = np.mean([(a > b) + 0.5 * (a == b) for a in score[truth] for b in score[~truth]])
    assert metrics.roc_auc(df, ["g"], F.col("truth"), "score").first()["auc"] == pytest.approx(wins)
    assert metrics.roc_auc(df.where("truth"), ["g"], F.col("truth"), "score").first()["auc"] is None
    d = spark.createDataFrame([(0.9, True), (0.8, False), (0.7, True), (0.6, False)], "score double, is_hit boolean")
    got = {r["rate"]: r["sensitivity"] for r in metrics.froc(d, images=2, targets=4, rates=(0.25, 0.5, 1, 8)).collect()}
    assert got == {0.25: 0.375, 0.5: 0.5, 1.0: 0.5, 8.0: 0.5}


def test_contracts(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    with pytest.raises(sets.ContractError, match="'a'"):
        sets.require_unique(df, "k")
    with pytest.raises(sets.ContractError, match="w"):
        sets.require_columns(df, ["k", "w"])
    with pytest.raises(sets.ContractError):
        sets.require_empty(df, "rows")
    with pytest.raises(ValueError):
        joins.fold_join([df, spark.createDataFrame([(1,)], "z int")])


def test_numbers_are_gapless(spark):
    df = spark.range(1000).selectExpr("(id * 37) % 1000 AS k").repartition(7)
    got = sorted((r["k"], r["__row"]) for r in joins.numbered(df, ["k"]).collect())
    assert got == [(i, i) for i in range(1000)]
    parts = windows.ratio_parts(df, ["k"], [0.5, 0.25, 0.25]).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {0: 500, 1: 250, 2: 250}
    assert windows.resampled(df, 1.5, ["k"]).count() == 1500


def test_scalars(spark):
    row = spark.createDataFrame([("SYN-MET-00012-001", "2.5", float("nan"))], "n string, t string, f double")
    got = row.select(
        *(c.alias(k) for k, c in scalars.case_parts("n").items()),
        scalars.has_value("f").alias("nan_has"),
        scalars.ratio("f", F.lit(2.0)).alias("r"),
        scalars.ratio(F.lit(1.0), F.lit(0.0)).alias("z"),
        scalars.softmax(F.array(F.lit(0.0), F.lit(0.0))).alias("s"),
        scalars.decode_regions({1: F.lit(0.9), 2: F.lit(0.6), 4: F.lit(0.1)}).alias("d"),
    ).first()
    assert (got["cohort"], got["subject"], got["visit"]) == ("SYN-MET", "00012", "001")
    assert got["nan_has"] is False and got["r"] is None and got["z"] is None and got["s"] == [0.5, 0.5] and got["d"] == 2


def test_suppression_is_that_of_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), int(k), float(rng.integers(0, 8)) / 8, float(x), float(x + w), 0.0, 1.0) for k, (g, x, w) in enumerate(zip(rng.integers(0, 4, 200), rng.integers(0, 60, 200), rng.integers(3, 15, 200), strict=True))]
    df = spark.createDataFrame(rows, "g long, box_id long, score double, x0 double, x1 double, y0 double, y1 double").repartition(5)
    want = set()
    for g in range(4):
        left = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        while left:
            best = left.pop(0)
            want.add(best[:2])
            inter = lambda r, b=best: max(0.0, min(r[4], b[4]) - max(r[3], b[3]))
            left = [r for r in left if inter(r) / (r[4] - r[3] + best[4] - best[3] - inter(r)) <= 0.5]
    assert {(r["g"], r["box_id"]) for r in suppression.suppressed(df, "g", 0.5).collect()} == want


def test_weighted_sample_is_that_of_python(spark):
    rows = [(k, float(1 + k % 9)) for k in range(300)] + [(900, 0.0)]
    score = lambda k: int(hashlib.sha256(f"7::{k}".encode()).hexdigest()[:16], 16) / 2**64
    want = sorted((-math.log(max(score(k), 1e-18)) / w, k) for k, w in rows if w > 0)[:40]
    got = windows.weighted_sample(spark.createDataFrame(rows, "k long, w double"), "k", "w", 40, 7).collect()
    assert [r["k"] for r in got] == [k for _, k in want]


def test_locked_split_keeps_what_was_held_out(spark):
    """Ten cases of which an earlier split held out two, a quarter of the rest for validation: 6, 2 and 2."""
    ids = [f"case_{k:06d}" for k in range(1, 11)]
    df = spark.createDataFrame([(x,) for x in ids], "id string")
    legacy = spark.createDataFrame([(x, "train") for x in ids[:8]] + [(x, "val") for x in ids[8:]] + [(ids[9], "val")], "id string, legacy string")
    got = {r["id"]: r["split"] for r in windows.locked_split(df, legacy, "id", 5, 0.25).collect()}
    assert set(got) == set(ids) and len(got) == 10
    assert {x for x, s in got.items() if s == "test"} == set(ids[8:])
    assert sorted(got.values()) == ["test"] * 2 + ["train"] * 6 + ["val"] * 2


def _case(**change):
    good = {n: True for n in ("source_is_allowed", "nifti_readable", "has_t1n", "has_t1c", "has_t2w", "has_t2f", "has_seg", "shape_consistent", "spacing_consistent", "affine_consistent", "label_is_integer", "label_values_valid", "source_is_fake_t2w_case", "source_shape_match", "roi_bbox_available", "source_final_qc_pass")}
    good |= {n: False for n in ("validation_leakage", "has_nan_or_inf", "empty_mask", "allow_empty_mask", "image_is_constant")}
    good |= {"source_completion_mode": "", "label_kind": "generation", "output_suffix_scheme": "native", "artifact_block_score": "", "tiny_lesion_ratio": "", "nonroi_change_ratio": "", "label_modality_alignment_score": ""}
    return good | change


def test_audit_cascades(spark):
    """Each rule alone, the thresholds' edges, and rules together."""
    cases = [
        (_case(), "A", "", ""),
        (_case(source_is_allowed=None, has_seg=False), "F", "source_not_allowed;missing_required_file", ""),
        (_case(validation_leakage=True), "F", "validation_leakage", ""),
        (_case(validation_leakage=True, label_kind="completion"), "C", "", "completion_source_not_training_allowed"),
        (_case(source_completion_mode="y", source_is_fake_t2w_case=False), "C", "", "completion_source_not_marked_fake_t2w"),
        (_case(empty_mask=True, allow_empty_mask=True), "A", "", ""),
        (_case(empty_mask=True), "F", "empty_mask", ""),
        (_case(artifact_block_score="0.85", tiny_lesion_ratio="0.5", nonroi_change_ratio="0.4", label_modality_alignment_score="1.0"), "A", "", ""),
        (_case(artifact_block_score="0.851", tiny_lesion_ratio="0.51"), "D", "", "block_artifact_suspected;tiny_ratio_high"),
        (_case(nonroi_change_ratio="0.41"), "D", "", "nonroi_change_high"),
        (_case(label_modality_alignment_score="0.99"), "D", "", "alignment_low"),
        (_case(roi_bbox_available=False), "C", "", "roi_missing"),
        (_case(roi_bbox_available=None), "A", "", ""),
        (_case(output_suffix_scheme="mixed", source_shape_match=False), "F", "mixed_suffix_scheme", "source_shape_mismatch"),
        (_case(output_suffix_scheme="legacy_met", source_final_qc_pass=False), "C", "", "legacy_suffix_normalized;source_final_qc_failed"),
    ]
    names = list(cases[0][0])
    schema = ", ".join(f"{n} {'boolean' if isinstance(cases[0][0][n], bool) else 'string'}" for n in names)
    df = spark.createDataFrame([(k, *(c[0][n] for n in names)) for k, c in enumerate(cases)], f"k int, {schema}")
    got = {r["k"]: r for r in audit.decided(df).collect()}
    for k, (_, grade, rejects, reviews) in enumerate(cases):
        assert (got[k]["quality_grade"], got[k]["hard_reject_reason"], got[k]["manual_review_reason"]) == (grade, rejects, reviews), k
        assert got[k]["accepted_for_training"] == (grade == "A") and got[k]["needs_regeneration"] == (grade in "DF")
        assert got[k]["qc_reject_reason"] == (rejects or reviews)


def test_first_key_goes_own_key_first(spark):
    docs = ['{"a": {"x": 1}, "x": 2}', '{"x": null, "a": {"x": 1}}', '[{"x": null}, {"x": {"y": 1}}]', "not json", None, "[" * 100000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(docs)], "k int, t string")
    got = {r["k"]: r["f"] for r in df.select("k", audit.first_key(df["t"], "x").alias("f")).collect()}
    assert got == {0: "2", 1: None, 2: '{"y":1}', 3: None, 4: None, 5: None}

