"""Quality audit of generated cases: rule cascades, source eligibility, replacements and paths."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.scalars import boolish, first_text

from .joins import one_row



def flag(name: str) -> Column:
    """A boolean column; null is false."""
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False))


def number(name: str) -> Column:
    """A number that may be written as text; blank and unreadable ones are null, so that no rule holds."""
    return F.col(name).cast("string").try_cast("double")


def is_completion(mode: str = "source_completion_mode", kind: str = "label_kind") -> Column:
    """Rows that complete a real case: flagged so, or labelled so."""
    return boolish(mode) | F.coalesce(F.col(kind) == "completion", F.lit(False))


#: The reasons in their order, with the thresholds that go with them.
ARTIFACT, TINY, NONROI, ALIGNED = 0.85, 0.5, 0.4, 1.0
REJECT: tuple[tuple[str, Callable[[], Column]], ...] = (
    ("source_not_allowed", lambda: ~flag("source_is_allowed")),
    ("validation_leakage", lambda: flag("validation_leakage") & ~is_completion()),
    ("image_has_nan_or_inf", lambda: flag("has_nan_or_inf")),
    ("nifti_unreadable", lambda: ~flag("nifti_readable")),
    ("missing_required_file", lambda: ~(flag("has_t1n") & flag("has_t1c") & flag("has_t2w") & flag("has_t2f") & flag("has_seg"))),
    ("shape_inconsistent", lambda: ~flag("shape_consistent")),
    ("spacing_inconsistent", lambda: ~flag("spacing_consistent")),
    ("affine_inconsistent", lambda: ~flag("affine_consistent")),
    ("label_not_integer", lambda: ~flag("label_is_integer")),
    ("illegal_label_values", lambda: ~flag("label_values_valid")),
    ("empty_mask", lambda: flag("empty_mask") & ~flag("allow_empty_mask")),
    ("constant_image", lambda: flag("image_is_constant")),
    ("mixed_suffix_scheme", lambda: F.col("output_suffix_scheme") == "mixed"),
)
REVIEW: tuple[tuple[str, Callable[[], Column]], ...] = (
    ("legacy_suffix_normalized", lambda: F.col("output_suffix_scheme") == "legacy_met"),
    ("completion_source_not_training_allowed", lambda: is_completion() & flag("validation_leakage")),
    ("completion_source_not_marked_fake_t2w", lambda: is_completion() & ~flag("source_is_fake_t2w_case")),
    ("source_shape_mismatch", lambda: ~flag("source_shape_match")),
    ("roi_missing", lambda: ~F.coalesce(F.col("roi_bbox_available").cast("boolean"), F.lit(True))),
    ("block_artifact_suspected", lambda: number("artifact_block_score") > ARTIFACT),
    ("tiny_ratio_high", lambda: number("tiny_lesion_ratio") > TINY),
    ("nonroi_change_high", lambda: number("nonroi_change_ratio") > NONROI),
    ("alignment_low", lambda: number("label_modality_alignment_score") < ALIGNED),
    ("source_final_qc_failed", lambda: ~flag("source_final_qc_pass")),
)
URGENT = ("source_shape_mismatch", "roi_missing", "block_artifact_suspected", "nonroi_change_high", "alignment_low")
REGENERATE = ("source_shape_mismatch", "block_artifact_suspected", "nonroi_change_high", "alignment_low")


def _reasons(rules: Sequence[tuple[str, Callable[[], Column]]]) -> Column:
    return F.array_compact(F.array(*(F.when(rule(), F.lit(name)) for name, rule in rules)))


def decided(rows: DataFrame) -> DataFrame:
    """Adds the reasons of both cascades in their order, and what follows from them: status, grade, decision and flags."""
    out = rows.withColumns({"__reject": _reasons(REJECT), "__review": _reasons(REVIEW)})
    reject, review = F.size("__reject") > 0, F.size("__review") > 0
    among = lambda names: F.arrays_overlap("__review", F.array(*(F.lit(n) for n in names)))
    again = ~reject & among(REGENERATE)
    out = out.withColumns(
        {
            "hard_reject": reject,
            "hard_reject_reason": F.concat_ws(";", "__reject"),
            "manual_review_required": review,
            "manual_review_reason": F.concat_ws(";", "__review"),
            "manual_review_priority": F.when(among(URGENT), "high").when(review, "medium").otherwise(""),
            "qc_status": F.when(reject, "reject").when(review, "review").otherwise("pass"),
            "quality_grade": F.when(reject, "F").when(again, "D").when(review, "C").otherwise("A"),
            "qc_decision": F.when(reject, "rejected").when(again, "needs_regeneration").when(review, "accepted_for_ablation_only").otherwise("accepted_for_training"),
            "accepted_for_training": ~reject & ~review,
            "accepted_for_ablation_only": ~reject & review & ~again,
            "needs_regeneration": reject | again,
            "regeneration_reason": F.when(reject, F.concat_ws(";", "__reject")).when(again, F.concat_ws(";", "__review")).otherwise(""),
        }
    )
    return out.withColumn("qc_reject_reason", F.coalesce(first_text("hard_reject_reason", "manual_review_reason"), F.lit(""))).drop("__reject", "__review")


def source_status(cases: DataFrame, train: DataFrame, val: DataFrame, placed: DataFrame, mapping: DataFrame, held: DataFrame, fake: DataFrame) -> DataFrame:
    """Adds whether a case's source may be used, by lookups on ``source_case_id``.

    ``cases`` (source_case_id, label_kind), ``train`` and ``val`` (case_id, final_qc_pass), ``placed``
    (case_id, usable_for_met96, allowed_as_synthetic_source), ``mapping`` (source_case_id, nnunet_case_id),
    ``held`` (nnunet_case_id) of the fixed validation fold, ``fake`` (case_id). Of an id's rows in a lookup the smallest counts, false before true.
    """
    key = "source_case_id"
    t = train.select(F.col("case_id").alias(key), F.lit(True).alias("in_train"), F.col("final_qc_pass").alias("train_pass"))
    v = val.select(F.col("case_id").alias(key), F.lit(True).alias("in_val"), F.col("final_qc_pass").alias("val_pass"))
    g = placed.select(F.col("case_id").alias(key), "usable_for_met96", "allowed_as_synthetic_source")
    m = one_row(mapping.select(key, "nnunet_case_id"), key).join(held.select("nnunet_case_id", F.lit(True).alias("in_fold")).distinct(), "nnunet_case_id", "left").select(key, "nnunet_case_id", "in_fold")
    f = fake.select(F.col("case_id").alias(key), F.lit(True).alias("is_fake"))
    out = cases
    for side in (t, v, g, m, f):
        out = out.join(one_row(side, key), key, "left")
    false = F.lit(False)
    in_train, in_val = F.coalesce("in_train", false), F.coalesce("in_val", false)
    ok = F.when(in_train, F.coalesce("train_pass", false)).otherwise(F.coalesce("val_pass", false))
    usable, in_fold = F.coalesce("usable_for_met96", false), F.coalesce("in_fold", false)
    clean = in_train & ok & ~in_val & ~in_fold
    completes = F.coalesce(F.col("label_kind") == "completion", false)
    allowed = clean & F.coalesce("allowed_as_synthetic_source", usable)
    return out.select(
        *cases.columns,
        F.coalesce("nnunet_case_id", F.lit("")).alias("nnunet_case_id"),
        in_train.alias("source_in_real_train_manifest"),
        ok.alias("source_final_qc_pass"),
        usable.alias("source_usable_for_met96"),
        F.when(completes, clean).otherwise(allowed).alias("source_allowed_for_training"),
        F.coalesce("is_fake", false).alias("source_is_fake_t2w_case"),
        completes.alias("source_completion_mode"),
        in_fold.alias("source_in_fixed_val_fold"),
        in_val.alias("source_from_official_validation"),
        F.when(completes, (in_train | in_val) & ok).otherwise(allowed).alias("source_is_allowed"),
        F.when(in_train, "train").when(in_val, "validation").otherwise("unknown").alias("source_split"),
    )


def source_paths(rows: DataFrame, key: str, candidates: Sequence[str], files: DataFrame, name: str = "source_path") -> DataFrame:
    """Adds the first of the candidate paths that a listing (path) has, else the first that isn't blank; ``key`` is unique."""
    asked = rows.select(key, F.posexplode(F.array(*candidates)).alias("__at", "path")).where(F.coalesce(F.col("path") != "", F.lit(False)))
    have = files.select("path", F.lit(True).alias("__there")).distinct()
    order = F.struct(F.col("__there").isNull(), F.col("__at"))
    best = asked.join(have, "path", "left").groupBy(key).agg(F.min_by("path", order).alias(name))
    return rows.join(best, key, "left")


def best_replacements(rows: DataFrame, order: str, path: str, allow_ablation: bool) -> DataFrame:
    """One completion row per source: the first accepted for training, else the first for ablation if that is allowed.

    Rows without a source or a path take no part; ``order`` numbers the rows.
    """
    trained, ablation = boolish("accepted_for_training"), boolish("accepted_for_ablation_only")
    able = is_completion() & (trained | (F.lit(allow_ablation) & ablation))
    named = F.coalesce((F.col("source_case_id") != "") & (F.col(path) != ""), F.lit(False))
    own = F.struct(*rows.columns)
    best = rows.where(able & named).groupBy("source_case_id").agg(F.min_by(own, F.struct(~trained, F.col(order))).alias("__r"))
    return best.select("__r.*")


def first_key(text: Column, key: str) -> Column:
    """The first value of ``key`` in JSON of any depth, as JSON text: an object's own key before its children's, children in order.

    A null value is passed over; text that isn't JSON has none. Depth has no bound in SQL, so this is an Arrow function.
    """

    def search(node: object) -> object | None:
        if isinstance(node, dict):
            if key in node:
                return node[key]
            node = list(node.values())
        if isinstance(node, list):
            return next((found for v in node if (found := search(v)) is not None), None)
        return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                found = search(json.loads(t)) if t is not None else None
            except (ValueError, RecursionError):
                return None
            return found if found is None or isinstance(found, str) else json.dumps(found, separators=(",", ":"))

        return texts.map(one, na_action=None)

    return run(text)
