"""Projection, filter and rule-cascade queries."""

from pyspark.sql import functions as F

from scanloom.functions import scalars as s
from scanloom.operators import sets

from .registry import register, table


@register("p1_boolean_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus = 'F') = TRUE")
def boolean_filter(spark, d):
    return table(spark, d, "orders").withColumn("ok", F.col("o_orderstatus") == "F").where("ok").select("o_orderkey", "o_totalprice")


@register(
    "p2_usable_rows",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR (TRUE AND o_orderpriority = '1-URGENT')",
)
def usable_rows(spark, d):
    o = table(spark, d, "orders")
    return o.where(s.usable(F.col("o_orderstatus") == "F", True, F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey")


@register(
    "p4_boolish",
    "SELECT event_id, lower(trim(CASE WHEN event_type = 'view' THEN ' Yes' WHEN event_type = 'click' THEN 'TRUE ' ELSE 'no' END)) IN ('1', 'true', 'yes', 'y') AS flag FROM events",
)
def boolish(spark, d):
    e = table(spark, d, "events")
    word = F.when(F.col("event_type") == "view", " Yes").when(F.col("event_type") == "click", "TRUE ").otherwise("no")
    return e.select("event_id", s.boolish(word).alias("flag"))


@register(
    "p5_has_value",
    "SELECT count(*) FILTER (WHERE trim(v) <> '') AS n_present, count(*) FILTER (WHERE v IS NULL OR trim(v) = '') AS n_absent"
    " FROM (SELECT CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN '  ' ELSE event_type END AS v FROM events)",
)
def present(spark, d):
    v = F.when(F.col("event_id") % 3 == 0, F.lit(None)).when(F.col("event_id") % 3 == 1, "  ").otherwise(F.col("event_type"))
    e = table(spark, d, "events").select(v.alias("v"))
    return e.agg(F.count_if(s.has_value("v")).alias("n_present"), F.count_if(~s.has_value("v")).alias("n_absent"))


@register("p6_all_present", "SELECT c_custkey FROM customer WHERE trim(c_name) <> '' AND trim(nullif(c_mktsegment, 'BUILDING')) <> ''")
def all_present(spark, d):
    c = table(spark, d, "customer")
    return c.where(s.all_present(["c_name", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))])).select("c_custkey")


@register("p7_split_filter", "SELECT o_orderkey FROM orders WHERE lower(trim(o_orderstatus)) = 'p'")
def split_filter(spark, d):
    return table(spark, d, "orders").where(s.in_split("o_orderstatus", "P")).select("o_orderkey")


@register("p8_padded_columns", "SELECT n_nationkey, n_name, '' AS notes, '' AS reviewer FROM nation")
def padded_columns(spark, d):
    return sets.pad_columns(table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_name", "notes", "reviewer"])


@register("p9_projection", "SELECT p_partkey AS case_id, p_brand AS site, p_size AS slices FROM part")
def projection(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("case_id"), F.col("p_brand").alias("site"), F.col("p_size").alias("slices"))


@register(
    "p11_fallback_id",
    "SELECT event_id, coalesce(nullif(CASE WHEN user_id % 2 = 0 THEN '' ELSE event_type END, ''), nullif(props, ''), 'none') AS id FROM events",
)
def fallback(spark, d):
    e = table(spark, d, "events")
    first = F.when(F.col("user_id") % 2 == 0, "").otherwise(F.col("event_type"))
    return e.select("event_id", s.first_text(first, "props", F.lit("none")).alias("id"))


_RULES_SQL = """
SELECT l_orderkey, l_linenumber, CASE WHEN concat_ws(';', CASE WHEN l_quantity < 5 THEN 'tiny_warning' END,
  CASE WHEN l_discount > 0.08 THEN 'high_discount' END, CASE WHEN l_tax > 0.07 THEN 'high_tax' END) = '' THEN 'pass'
  ELSE concat_ws(';', CASE WHEN l_quantity < 5 THEN 'tiny_warning' END, CASE WHEN l_discount > 0.08 THEN 'high_discount' END,
  CASE WHEN l_tax > 0.07 THEN 'high_tax' END) END AS reasons,
  (CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END) + (CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END) AS n_blocking
FROM lineitem
"""


@register("p12_p13_reasons", _RULES_SQL)
def reason_lists(spark, d):
    found = s.reasons([(F.col("l_quantity") < 5, "tiny_warning"), (F.col("l_discount") > 0.08, "high_discount"), (F.col("l_tax") > 0.07, "high_tax")])
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", found.alias("found"))
    return li.select("l_orderkey", "l_linenumber", s.reason_text(F.col("found")).alias("reasons"), F.size(s.blocking(F.col("found"))).alias("n_blocking"))


@register(
    "p14_p16_grades",
    """
SELECT grade, count(*) AS n FROM (SELECT CASE WHEN o_totalprice < 20000 OR o_orderstatus = 'P' THEN 'F'
  WHEN o_orderpriority = '5-LOW' AND o_totalprice > 300000 THEN 'D'
  WHEN o_orderpriority = '4-NOT SPECIFIED' OR o_orderpriority = '5-LOW' OR o_totalprice > 400000 THEN 'C' ELSE 'A' END AS grade FROM orders) GROUP BY grade
""",
)
def grades(spark, d):
    low, dear = F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice") > 300000
    reject = s.reasons([(F.col("o_totalprice") < 20000, "too_cheap"), (F.col("o_orderstatus") == "P", "pending")])
    review = s.reasons([(low & dear, "regenerate"), (low, "low"), (F.col("o_totalprice") > 400000, "dear")])
    g = s.grade(reject, review, ["regenerate"], F.col("o_orderpriority") == "4-NOT SPECIFIED")
    return table(spark, d, "orders").select(g.alias("grade")).groupBy("grade").agg(F.count("*").alias("n"))


@register(
    "p17_eligibility",
    """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN c_acctbal > 0 ELSE coalesce(n_regionkey <> 2, FALSE) END AS eligible
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
""",
)
def eligibility(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    o = o.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    ok = F.when(F.col("o_orderstatus") == "O", F.col("c_acctbal") > 0).otherwise(F.coalesce(F.col("n_regionkey") != 2, F.lit(False)))
    return o.select("o_orderkey", ok.alias("eligible"))


@register(
    "p18_volume_buckets",
    "SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN 8 * l_quantity < 27 THEN 'tiny' WHEN 8 * l_quantity <= 275 THEN 'small' ELSE 'large' END AS bucket FROM lineitem) GROUP BY bucket",
)
def buckets(spark, d):
    return table(spark, d, "lineitem").select(s.volume_bucket(8 * F.col("l_quantity")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@register("p19_large_split", "SELECT l_quantity >= 27 AS is_large, count(*) AS n FROM lineitem GROUP BY 1")
def large(spark, d):
    return table(spark, d, "lineitem").groupBy((F.col("l_quantity") >= 27).alias("is_large")).agg(F.count("*").alias("n"))


@register(
    "p20_usable_size",
    "SELECT p_partkey FROM part WHERE greatest(p_size, CAST(p_partkey % 120 AS INTEGER)) <= 96 AND least(p_size, CAST(p_partkey % 120 AS INTEGER)) > 0",
)
def usable_size(spark, d):
    other = (F.col("p_partkey") % 120).cast("int")
    return table(spark, d, "part").where((F.greatest("p_size", other) <= 96) & (F.least("p_size", other) > 0)).select("p_partkey")


@register(
    "p21_label_combination",
    """
SELECT combo, count(*) AS n FROM (SELECT CASE WHEN c = '' THEN 'none' ELSE c END AS combo FROM (SELECT concat_ws('+',
  CASE WHEN p_size > 25 THEN 'NETC' END, CASE WHEN p_size % 2 = 0 THEN 'SNFH' END, CASE WHEN p_size % 3 = 0 THEN 'ET' END) AS c FROM part)) GROUP BY combo
""",
)
def combination(spark, d):
    c = s.label_combination({"NETC": F.col("p_size") > 25, "SNFH": F.col("p_size") % 2 == 0, "ET": F.col("p_size") % 3 == 0})
    return table(spark, d, "part").select(c.alias("combo")).groupBy("combo").agg(F.count("*").alias("n"))


@register(
    "p22_suffix_scheme",
    """
SELECT user_id, CASE WHEN a AND b THEN 'mixed' WHEN a THEN 'legacy' WHEN b THEN 'native' ELSE 'unknown' END AS scheme
FROM (SELECT user_id, bool_or(event_type = 'click') AS a, bool_or(event_type = 'purchase') AS b FROM events GROUP BY user_id)
""",
)
def scheme(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "click").alias("a"), F.bool_or(F.col("event_type") == "purchase").alias("b"))
    return g.select("user_id", F.when(F.col("a") & F.col("b"), "mixed").when(F.col("a"), "legacy").when(F.col("b"), "native").otherwise("unknown").alias("scheme"))


@register(
    "p23_routing",
    "SELECT 'accepted' AS route, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE value > 50 UNION ALL SELECT 'rejected', count(*), round(sum(value), 2) FROM events WHERE NOT coalesce(value > 50, FALSE)",
)
def routing(spark, d):
    e = table(spark, d, "events")
    route = F.when(F.coalesce(F.col("value") > 50, F.lit(False)), "accepted").otherwise("rejected")
    return e.groupBy(route.alias("route")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@register("p24_remap", "SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 4 THEN 3 ELSE l_linenumber END AS label FROM lineitem")
def remap(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", s.remap("l_linenumber", {1: 2, 2: 1, 4: 3}).alias("label"))


@register("p25_clamp", "SELECT event_id, least(greatest(value, 0), 40) AS value FROM events")
def clamp(spark, d):
    return table(spark, d, "events").select("event_id", s.clamp("value", 0.0, 40.0).alias("value"))


@register("p26_binarise", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS mask FROM lineitem")
def binarise(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") > 0.05).cast("int").alias("mask"))


@register("p27_derived_labels", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 4 THEN 0 ELSE l_linenumber END AS tumour, CAST(l_linenumber = 4 AS INTEGER) AS cavity FROM lineitem")
def derived(spark, d):
    c = F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(c == 4, 0).otherwise(c).alias("tumour"), (c == 4).cast("int").alias("cavity"))


@register("p28_regions", "SELECT l_linenumber, sum(CAST(l_linenumber IN (1, 3) AS BIGINT)) AS tc, sum(CAST(l_linenumber IN (1, 2, 3) AS BIGINT)) AS wt, sum(CAST(l_linenumber = 3 AS BIGINT)) AS et FROM lineitem GROUP BY l_linenumber")
def regions(spark, d):
    r = s.regions("l_linenumber")
    return table(spark, d, "lineitem").groupBy("l_linenumber").agg(*(F.count_if(c).alias(k) for k, c in r.items()))


@register("p29_grouped_columns", "SELECT l_orderkey, l_linenumber, array_to_string([CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), l_returnflag], '|') AS packed FROM lineitem")
def grouped(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").cast("string").alias("q"), "l_returnflag")
    return sets.grouped_columns(li, {"g": ["q", "l_returnflag"]}).select("l_orderkey", "l_linenumber", F.concat_ws("|", "g").alias("packed"))


@register("p30_casts", "SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(floor(c_acctbal) AS BIGINT) AS balance FROM customer")
def casts(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.floor("c_acctbal").cast("bigint").alias("balance"))


@register("p31_fill", "SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END, -1) AS value, coalesce(nullif(event_type, 'view'), 'unseen') AS kind FROM events")
def filled(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"), F.nullif("event_type", F.lit("view")).alias("kind"))
    return sets.fill(e, {"value": -1.0, "kind": "unseen"})


@register("p32_row_ranges", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r BETWEEN 10 AND 19 OR r IN (0, 100, 200)")
def row_ranges(spark, d):
    from scanloom.operators.joins import numbered

    o = numbered(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])
    return o.where(F.col("__row").between(10, 19) | F.col("__row").isin(0, 100, 200)).select("o_orderkey")


@register("p34_pipeline", "SELECT s_suppkey, upper(s_name) AS name, round(s_acctbal * 2, 2) AS twice FROM supplier WHERE s_acctbal > 0")
def pipeline(spark, d):
    steps = [lambda x: x.where("s_acctbal > 0"), lambda x: x.withColumn("name", F.upper("s_name")), lambda x: x.withColumn("twice", F.round(F.col("s_acctbal") * 2, 2))]
    out = table(spark, d, "supplier")
    for f in steps:
        out = out.transform(f)
    return out.select("s_suppkey", "name", "twice")


@register("p36_error_rows", "SELECT event_id FROM events WHERE CASE WHEN value < 1 THEN 'bad' END IS NULL")
def errors(spark, d):
    return table(spark, d, "events").withColumn("error", F.when(F.col("value") < 1, "bad")).where("error is null").select("event_id")


@register("p37_removed_keys", "SELECT r_regionkey FROM region")
def removed(spark, d):
    return table(spark, d, "region").drop("r_name")


@register("p38_channels", "SELECT p_partkey, p_size AS first, p_size AS repeated, 3 AS n FROM part")
def channels(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.array_repeat("p_size", 3).alias("c"))
    return p.select("p_partkey", F.get("c", F.lit(0)).alias("first"), F.element_at(F.slice("c", 2, 2), -1).alias("repeated"), F.size("c").alias("n"))
