"""Audit queries: cascades, source eligibility, replacements, path choice and recursive keys, over columns made of the tables' keys."""

from pyspark.sql import functions as F

from scanloom.operators import audit

from .registry import register, table

_CASE = [
    "o_orderkey",
    "o_orderkey % 11 <> 0 AS source_is_allowed",
    "o_orderkey % 13 = 0 AS validation_leakage",
    "CASE WHEN o_orderkey % 17 = 0 THEN 'Yes' ELSE '' END AS source_completion_mode",
    "CASE WHEN o_orderkey % 3 = 0 THEN 'completion' ELSE 'generation' END AS label_kind",
    "o_orderkey % 19 = 0 AS has_nan_or_inf",
    "o_orderkey % 23 <> 0 AS nifti_readable",
    "o_orderkey % 29 <> 0 AS has_t1n",
    "TRUE AS has_t1c",
    "CASE WHEN o_orderkey % 83 <> 0 THEN TRUE END AS has_t2w",
    "TRUE AS has_t2f",
    "o_orderkey % 89 <> 0 AS has_seg",
    "o_orderkey % 31 <> 0 AS shape_consistent",
    "o_orderkey % 37 <> 0 AS spacing_consistent",
    "o_orderkey % 41 <> 0 AS affine_consistent",
    "o_orderkey % 43 <> 0 AS label_is_integer",
    "o_orderkey % 47 <> 0 AS label_values_valid",
    "o_orderkey % 7 = 0 AS empty_mask",
    "o_orderkey % 14 = 0 AS allow_empty_mask",
    "o_orderkey % 53 = 0 AS image_is_constant",
    "CASE WHEN o_orderkey % 59 = 0 THEN 'mixed' WHEN o_orderkey % 5 = 0 THEN 'legacy_met' ELSE 'native' END AS output_suffix_scheme",
    "o_orderkey % 2 = 0 AS source_is_fake_t2w_case",
    "o_orderkey % 61 <> 0 AS source_shape_match",
    "CASE WHEN o_orderkey % 67 = 0 THEN FALSE WHEN o_orderkey % 71 <> 0 THEN TRUE END AS roi_bbox_available",
    "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE CAST(CAST(o_custkey % 100 AS DOUBLE) / 100 AS STRING) END AS artifact_block_score",
    "CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE CAST(CAST(o_custkey % 53 AS DOUBLE) / 100 AS STRING) END AS tiny_lesion_ratio",
    "CAST(o_custkey % 44 AS DOUBLE) / 100 AS nonroi_change_ratio",
    "CASE WHEN o_custkey % 10 = 0 THEN 0.99 WHEN o_custkey % 10 < 8 THEN 1.0 END AS label_modality_alignment_score",
    "o_orderkey % 73 <> 0 AS source_final_qc_pass",
]

_DONE = "(source_completion_mode = 'Yes' OR label_kind = 'completion')"
_REJECT_SQL = f"""concat_ws(';', CASE WHEN NOT source_is_allowed THEN 'source_not_allowed' END,
  CASE WHEN validation_leakage AND NOT {_DONE} THEN 'validation_leakage' END, CASE WHEN has_nan_or_inf THEN 'image_has_nan_or_inf' END,
  CASE WHEN NOT nifti_readable THEN 'nifti_unreadable' END,
  CASE WHEN NOT has_t1n OR NOT has_t1c OR NOT coalesce(has_t2w, FALSE) OR NOT has_t2f OR NOT has_seg THEN 'missing_required_file' END,
  CASE WHEN NOT shape_consistent THEN 'shape_inconsistent' END, CASE WHEN NOT spacing_consistent THEN 'spacing_inconsistent' END,
  CASE WHEN NOT affine_consistent THEN 'affine_inconsistent' END, CASE WHEN NOT label_is_integer THEN 'label_not_integer' END,
  CASE WHEN NOT label_values_valid THEN 'illegal_label_values' END, CASE WHEN empty_mask AND NOT allow_empty_mask THEN 'empty_mask' END,
  CASE WHEN image_is_constant THEN 'constant_image' END, CASE WHEN output_suffix_scheme = 'mixed' THEN 'mixed_suffix_scheme' END)"""
_REVIEW_SQL = f"""concat_ws(';', CASE WHEN output_suffix_scheme = 'legacy_met' THEN 'legacy_suffix_normalized' END,
  CASE WHEN {_DONE} AND validation_leakage THEN 'completion_source_not_training_allowed' END,
  CASE WHEN {_DONE} AND NOT source_is_fake_t2w_case THEN 'completion_source_not_marked_fake_t2w' END,
  CASE WHEN NOT source_shape_match THEN 'source_shape_mismatch' END, CASE WHEN roi_bbox_available = FALSE THEN 'roi_missing' END,
  CASE WHEN TRY_CAST(artifact_block_score AS DOUBLE) > 0.85 THEN 'block_artifact_suspected' END,
  CASE WHEN TRY_CAST(tiny_lesion_ratio AS DOUBLE) > 0.5 THEN 'tiny_ratio_high' END, CASE WHEN nonroi_change_ratio > 0.4 THEN 'nonroi_change_high' END,
  CASE WHEN label_modality_alignment_score < 1.0 THEN 'alignment_low' END, CASE WHEN NOT source_final_qc_pass THEN 'source_final_qc_failed' END)"""
_CASES_SQL = f"SELECT {', '.join(_CASE)} FROM orders"
_REASONS_SQL = f"SELECT *, {_REJECT_SQL} AS rejects, {_REVIEW_SQL} AS reviews FROM ({_CASES_SQL})"


def cases(spark, d):
    return table(spark, d, "orders").selectExpr(*_CASE)


@register("p14_reject_cascade", f"SELECT o_orderkey, rejects <> '' AS hard_reject, rejects AS hard_reject_reason FROM ({_REASONS_SQL})")
def reject_cascade(spark, d):
    return audit.decided(cases(spark, d)).select("o_orderkey", "hard_reject", "hard_reject_reason")


@register(
    "p15_review_cascade",
    f"""SELECT o_orderkey, reviews AS manual_review_reason, CASE WHEN regexp_matches(reviews, 'source_shape_mismatch|roi_missing|block_artifact_suspected|nonroi_change_high|alignment_low')
  THEN 'high' WHEN reviews <> '' THEN 'medium' ELSE '' END AS manual_review_priority FROM ({_REASONS_SQL})""",
)
def review_cascade(spark, d):
    return audit.decided(cases(spark, d)).select("o_orderkey", "manual_review_reason", "manual_review_priority")


@register(
    "p16_decisions",
    f"""SELECT o_orderkey, CASE WHEN rejects <> '' THEN 'reject' WHEN reviews <> '' THEN 'review' ELSE 'pass' END AS qc_status,
  CASE WHEN rejects <> '' THEN 'F' WHEN again THEN 'D' WHEN reviews <> '' THEN 'C' ELSE 'A' END AS quality_grade,
  CASE WHEN rejects <> '' THEN 'rejected' WHEN again THEN 'needs_regeneration' WHEN reviews <> '' THEN 'accepted_for_ablation_only' ELSE 'accepted_for_training' END AS qc_decision,
  CASE WHEN rejects <> '' THEN rejects WHEN again THEN reviews ELSE '' END AS regeneration_reason, CASE WHEN rejects <> '' THEN rejects ELSE reviews END AS qc_reject_reason
FROM (SELECT *, regexp_matches(reviews, 'source_shape_mismatch|block_artifact_suspected|nonroi_change_high|alignment_low') AS again FROM ({_REASONS_SQL}))""",
)
def decisions(spark, d):
    return audit.decided(cases(spark, d)).select("o_orderkey", "qc_status", "quality_grade", "qc_decision", "regeneration_reason", "qc_reject_reason")


@register("p3_completion_rows", f"SELECT o_orderkey FROM ({_CASES_SQL}) WHERE source_completion_mode = 'Yes' OR label_kind = 'completion'")
def completion_rows(spark, d):
    return cases(spark, d).where(audit.is_completion()).select("o_orderkey")


@register(
    "p17_source_status",
    """
WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'completion' ELSE 'generation' END AS kind, c_custkey % 4 <> 0 AS tr, c_custkey % 5 = 0 AS va,
  CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal > 0 WHEN c_custkey % 5 = 0 THEN c_acctbal > 1000 ELSE FALSE END AS ok,
  CASE WHEN c_custkey % 2 = 0 THEN coalesce(CASE WHEN c_custkey % 8 <> 0 THEN c_custkey % 6 = 0 END, c_custkey % 10 <> 0) ELSE FALSE END AS may,
  c_custkey % 7 <> 0 AND c_custkey % 9 = 0 AS fold FROM customer),
s AS (SELECT *, tr AND ok AND NOT va AND NOT fold AS clean FROM c)
SELECT k AS source_case_id, CASE WHEN kind = 'completion' THEN (tr OR va) AND ok ELSE clean AND may END AS source_is_allowed,
  CASE WHEN kind = 'completion' THEN clean ELSE clean AND may END AS source_allowed_for_training, fold AS source_in_fixed_val_fold,
  CASE WHEN tr THEN 'train' WHEN va THEN 'validation' ELSE 'unknown' END AS source_split, k % 6 = 0 AS source_is_fake_t2w_case FROM s
""",
)
def source_status(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), "c_acctbal")
    k = F.col("case_id")
    named = c.select(k.alias("source_case_id"), F.concat(F.lit("N"), k.cast("string")).alias("nnunet_case_id"))
    out = audit.source_status(
        c.select(k.alias("source_case_id"), F.when(k % 3 == 0, "completion").otherwise("generation").alias("label_kind")),
        c.where(k % 4 != 0).select("case_id", (F.col("c_acctbal") > 0).alias("final_qc_pass")),
        c.where(k % 5 == 0).select("case_id", (F.col("c_acctbal") > 1000).alias("final_qc_pass")),
        c.where(k % 2 == 0).select("case_id", (k % 10 != 0).alias("usable_for_met96"), F.when(k % 8 != 0, k % 6 == 0).alias("allowed_as_synthetic_source")),
        named.where("source_case_id % 7 <> 0"),
        named.where("source_case_id % 9 = 0").select("nnunet_case_id"),
        c.where(k % 6 == 0).select("case_id"),
    )
    return out.select("source_case_id", "source_is_allowed", "source_allowed_for_training", "source_in_fixed_val_fold", "source_split", "source_is_fake_t2w_case")


_PATHS = [
    "o_orderkey",
    "o_custkey",
    "CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE concat('a/', o_orderkey) END AS t2w_source_path",
    "CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE concat('b/', o_orderkey) END AS normalized_t2w_path",
    "CASE WHEN o_orderkey % 4 <> 1 THEN concat('c/', o_orderkey) END AS raw_t2w_path",
]
_CHOSEN = f"""SELECT *, CASE WHEN t2w_source_path <> '' AND o_orderkey % 5 = 0 THEN t2w_source_path WHEN normalized_t2w_path <> '' AND o_orderkey % 3 = 0 THEN normalized_t2w_path
  ELSE coalesce(nullif(t2w_source_path, ''), nullif(normalized_t2w_path, ''), raw_t2w_path) END AS source_path FROM (SELECT {', '.join(_PATHS)} FROM orders)"""


def chosen(spark, d):
    o = table(spark, d, "orders").selectExpr(*_PATHS)
    there = o.where("o_orderkey % 5 = 0").select(F.concat(F.lit("a/"), F.col("o_orderkey").cast("string")).alias("path"))
    there = there.union(o.where("o_orderkey % 3 = 0").select(F.concat(F.lit("b/"), F.col("o_orderkey").cast("string"))))
    return audit.source_paths(o, "o_orderkey", ["t2w_source_path", "normalized_t2w_path", "raw_t2w_path"], there)


@register("p10_source_paths", f"SELECT o_orderkey, source_path FROM ({_CHOSEN})")
def source_paths(spark, d):
    return chosen(spark, d).select("o_orderkey", "source_path")


@register(
    "j21_replacements",
    f"""SELECT source_case_id, o_orderkey, source_path FROM (SELECT *, row_number() OVER (PARTITION BY source_case_id ORDER BY CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END, o_orderkey) AS r
  FROM (SELECT *, CASE WHEN o_custkey % 9 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS source_case_id FROM ({_CHOSEN}))
  WHERE (o_orderkey % 17 = 0 OR o_orderkey % 3 = 0) AND (o_orderkey % 5 = 0 OR o_orderkey % 2 = 0) AND source_case_id <> '' AND source_path <> '') WHERE r = 1""",
)
def replacements(spark, d):
    k = F.col("o_orderkey")
    rows = chosen(spark, d).withColumns(
        {
            "source_case_id": F.when(F.col("o_custkey") % 9 == 0, "").otherwise(F.col("o_custkey").cast("string")),
            "source_completion_mode": F.when(k % 17 == 0, "TRUE").otherwise("no"),
            "label_kind": F.when(k % 3 == 0, "completion"),
            "accepted_for_training": F.when(k % 5 == 0, "1").otherwise("0"),
            "accepted_for_ablation_only": F.when(k % 2 == 0, "y"),
        }
    )
    return audit.best_replacements(rows, "o_orderkey", "source_path", allow_ablation=True).select("source_case_id", "o_orderkey", "source_path")


@register("f35_first_key", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN '[' || event_id || ']' WHEN 3 THEN event_type END AS found FROM events")
def first_key(spark, d):
    i = F.col("event_id").cast("string")
    doc = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"a": {"x": null}, "l": [{"y": 1}, {"x": '), i, F.lit('}], "z": {"x": 0}}')))
    doc = doc.when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"z": {"q": {"x": "deep"}}, "x": ['), i, F.lit("]}")))
    doc = doc.when(F.col("event_id") % 4 == 2, '{"x": null, "a": {"x": 5}}').otherwise(F.concat(F.lit('[[], [[{"x": "'), F.col("event_type"), F.lit('"}]]]')))
    return table(spark, d, "events").select("event_id", audit.first_key(doc, "x").alias("found"))
