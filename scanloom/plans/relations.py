"""Join and set-operator queries."""

from pyspark.sql import functions as F

from scanloom.operators import joins as j
from scanloom.operators import sets

from .registry import register, table


@register(
    "j1_left_overlay",
    "SELECT n.n_nationkey, coalesce(q.status, 'raw') AS status FROM nation n LEFT JOIN (SELECT n_nationkey, 'fixed' AS status FROM nation WHERE n_regionkey = 1) q USING (n_nationkey)",
)
def overlay(spark, d):
    n = table(spark, d, "nation")
    q = n.where("n_regionkey = 1").select("n_nationkey", F.lit("fixed").alias("status"))
    return j.left_overlay(n.select("n_nationkey", F.lit("raw").alias("status")), q, "n_nationkey", "_qc", ["status"])


@register(
    "j2_lookups",
    "SELECT o_orderkey, c_mktsegment, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
)
def lookups(spark, d):
    t = lambda n: table(spark, d, n)
    out = j.lookups(t("orders"), [(t("customer"), "c_custkey", "o_custkey"), (t("nation"), "n_nationkey", "c_nationkey"), (t("region"), "r_regionkey", "n_regionkey")])
    return out.select("o_orderkey", "c_mktsegment", "n_name", "r_name")


@register(
    "j3_fold_join",
    "SELECT k, a, b, c FROM (SELECT s_suppkey AS k, s_name AS a FROM supplier) JOIN (SELECT s_suppkey AS k, s_nationkey AS b FROM supplier WHERE s_acctbal > 0) USING (k) JOIN (SELECT s_suppkey AS k, round(s_acctbal, 2) AS c FROM supplier) USING (k)",
)
def fold(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey").alias("k")
    return j.fold_join([s.select(k, F.col("s_name").alias("a")), s.where("s_acctbal > 0").select(k, F.col("s_nationkey").alias("b")), s.select(k, F.round("s_acctbal", 2).alias("c"))])


@register(
    "j4_chunk_join",
    """
WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS x, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS c FROM orders WHERE o_orderkey % 2 = 0),
b AS (SELECT o_orderkey AS k, o_orderpriority AS y, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS c FROM orders WHERE o_orderkey % 3 = 0)
SELECT a.k, x, y FROM a JOIN b ON a.k = b.k AND a.c = b.c
""",
)
def chunk(spark, d):
    o = table(spark, d, "orders")
    a = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("x"))
    b = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("y"))
    return j.chunk_join(a, b, ["k"], 100, ["k"])


_CORR = "SELECT p_partkey, p_size AS shape, 'fixed' AS label FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT p_partkey, p_size + 1, 'fixed' FROM part WHERE p_partkey % 11 = 0 AND p_partkey % 7 <> 0"


@register(
    "j5_corrections",
    f"SELECT r.p_partkey, CASE WHEN c.shape = r.p_size THEN c.label ELSE p_brand END AS label, coalesce(c.shape = r.p_size, FALSE) AS applied FROM part r LEFT JOIN ({_CORR}) c USING (p_partkey)",
)
def corrections(spark, d):
    p = table(spark, d, "part")
    key = F.col("p_partkey")
    c = p.where(key % 7 == 0).select(key, F.col("p_size").alias("shape"), F.lit("fixed").alias("label"))
    c = c.union(p.where((key % 11 == 0) & (key % 7 != 0)).select(key, F.col("p_size") + 1, F.lit("fixed")))
    raw = p.select(key, F.col("p_size").alias("shape"), F.col("p_brand").alias("label"))
    return j.overlay_corrections(raw, c, "p_partkey", "label", F.col("shape") == F.col("corrected_shape"))[0].select("p_partkey", "label", "applied")


@register(
    "j6_copy_or_not_found",
    "SELECT c_custkey, coalesce(p, 'NOT FOUND') AS o_orderpriority FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS p FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey",
)
def copy_or(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return j.copy_or(table(spark, d, "customer").select("c_custkey"), o, "c_custkey", "o_orderpriority")


@register(
    "j7_j8_precedence",
    "SELECT c_custkey, coalesce(CASE WHEN f THEN 'F' WHEN o THEN 'O' WHEN p THEN 'P' END, 'none') AS o_orderstatus FROM customer LEFT JOIN (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS f, bool_or(o_orderstatus = 'O') AS o, bool_or(o_orderstatus = 'P') AS p FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey",
)
def precedence(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return j.with_precedence(table(spark, d, "customer").select("c_custkey"), o, "c_custkey", "o_orderstatus", ["F", "O", "P"], "none")


@register("j9_unknown_ids", "SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def unknown(spark, d):
    known = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return j.unknown_ids(table(spark, d, "lineitem"), known, "l_suppkey", None)


@register(
    "j10_drop_unreplaced",
    "SELECT p_partkey FROM part WHERE NOT (p_size > 40 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45))",
)
def unreplaced(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    done = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return j.drop_unreplaced(p, p.where("p_size > 40"), done, "p_partkey").select("p_partkey")


@register("j11_substring_anti", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM region r WHERE contains(c.c_mktsegment || c.c_name, substr(r.r_name, 1, 2)))")
def substring_anti(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.concat("c_mktsegment", "c_name").alias("t"))
    return j.containing(c, "t", table(spark, d, "region").select(F.substring("r_name", 1, 2).alias("n")), "n").select("c_custkey")


@register("j12_leakage", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM nation n WHERE contains(c.c_name, substr(n.n_name, 8) || '0'))")
def leakage(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return j.containing(c, "c_name", table(spark, d, "nation").select(F.concat(F.substring("n_name", 8, 9), F.lit("0")).alias("n")), "n", keep=True).select("c_custkey")


_CASE_ID = "lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0') || '-' || lpad(CAST(p_partkey // 100000 AS VARCHAR), 3, '0')"


@register("j13_suffix_match", f"SELECT {_CASE_ID} AS id, CASE WHEN p_partkey % 3 = 0 THEN 'pred-' || {_CASE_ID} || '.nii.gz' END AS file FROM part")
def suffix(spark, d):
    """Five digits of the key and a visit number of the others, so that every part has an id."""
    k = F.col("p_partkey")
    five, visit = F.lpad((k % 100000).cast("string"), 5, "0"), F.lpad(F.floor(k / 100000).cast("string"), 3, "0")
    p = table(spark, d, "part").select("p_partkey", F.concat(five, F.lit("-"), visit).alias("id"))
    files = p.where("p_partkey % 3 = 0").select(F.concat(F.lit("pred-"), "id", F.lit(".nii.gz")).alias("file"))
    return j.by_suffix(p.select("id"), "id", files, "file", ".nii.gz")


@register("j14_path_pairs", "SELECT a.p_name, a.n AS left_n, b.n AS right_n FROM (SELECT p_name, count(*) AS n FROM part WHERE p_size <= 25 GROUP BY 1) a JOIN (SELECT p_name, count(*) AS n FROM part WHERE p_size > 25 GROUP BY 1) b USING (p_name)")
def path_pairs(spark, d):
    p = table(spark, d, "part")
    a = p.where("p_size <= 25").groupBy("p_name").agg(F.count("*").alias("left_n"))
    return a.join(p.where("p_size > 25").groupBy("p_name").agg(F.count("*").alias("right_n")), "p_name")


@register(
    "j15_zip",
    "SELECT s_suppkey, n_nationkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier) JOIN (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation) USING (r)",
)
def zipped(spark, d):
    return j.zip_rows(table(spark, d, "supplier").select("s_suppkey"), table(spark, d, "nation").select("n_nationkey"), ["s_suppkey"], ["n_nationkey"])


_BOXES = "SELECT l_orderkey AS g, l_linenumber AS i, l_quantity AS x0, l_quantity + 10 AS x1, l_discount * 100 AS y0, l_discount * 100 + 5 AS y1 FROM lineitem"


@register(
    "j19_box_overlap",
    f"""
WITH b AS ({_BOXES}), p AS (SELECT a.g, a.i AS a_i, c.i AS b_i,
  greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) AS inter,
  (a.x1 - a.x0) * (a.y1 - a.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) AS total FROM b a JOIN b c ON a.g = c.g AND a.i < c.i)
SELECT g, a_i, b_i, round(inter / (total - inter), 6) AS iou, count(*) AS n FROM p WHERE inter > 1e-9 GROUP BY 1, 2, 3, 4
""",
)
def boxes(spark, d):
    li = table(spark, d, "lineitem")
    b = li.select(
        F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 10).alias("x1"), (F.col("l_discount") * 100).alias("y0"), (F.col("l_discount") * 100 + 5).alias("y1")
    )
    out = j.box_overlap(b, b, "g", 20.0, ["x", "y"]).where("a_i < b_i and inter > 1e-9")
    return out.groupBy("g", "a_i", "b_i", F.round("iou", 6).alias("iou")).agg(F.count("*").alias("n"))


@register("j20_box_contains", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount BETWEEN 0.02 AND 0.06")
def box_contains(spark, d):
    return table(spark, d, "lineitem").where(F.col("l_quantity").between(10, 20) & F.col("l_discount").between(0.02, 0.06)).select("l_orderkey", "l_linenumber")


@register(
    "j22_in_every_group",
    "SELECT p_name, count(DISTINCT p_brand) AS groups FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) < (SELECT count(DISTINCT p_brand) FROM part)",
)
def every_group(spark, d):
    return sets.in_every(table(spark, d, "part"), "p_name", "p_brand")


@register(
    "j24_two_way",
    "SELECT coalesce(a, b) AS k, CASE WHEN b IS NULL THEN 'left_only' ELSE 'right_only' END AS side FROM (SELECT DISTINCT o_custkey AS a FROM orders WHERE o_orderstatus = 'F') FULL JOIN (SELECT DISTINCT o_custkey AS b FROM orders WHERE o_orderstatus = 'P') ON a = b WHERE a IS NULL OR b IS NULL",
)
def two_way(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return j.two_way(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), "k")


@register("u1_union_unlike", "SELECT r_name AS name, NULL AS region, 1 AS kind FROM region UNION ALL SELECT n_name, n_regionkey, 2 FROM nation")
def unlike(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    return sets.union_rows(r.select(F.col("r_name").alias("name"), F.lit(1).alias("kind")), n.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), F.lit(2).alias("kind"))).select("name", "region", "kind")


@register("u2_union_unique", "SELECT 'S' || s_suppkey AS id FROM supplier UNION ALL SELECT 'C' || c_custkey FROM customer")
def unique(spark, d):
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    return sets.union_unique("id", s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id")), c.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id")))


@register("u3_set_difference", "SELECT o_custkey FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def difference(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_custkey").subtract(o.where("o_orderstatus = 'F'").select("o_custkey"))


@register("u3_set_intersection", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def intersection(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'O'").select("o_custkey").intersect(o.where("o_orderstatus = 'F'").select("o_custkey"))


@register(
    "u4_id_match",
    "SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS \"both\", count(*) AS \"either\", count(*) FILTER (WHERE b IS NULL) AS only_a, count(*) FILTER (WHERE a IS NULL) AS only_b FROM (SELECT DISTINCT l_suppkey AS a FROM lineitem WHERE l_quantity > 49) FULL JOIN (SELECT DISTINCT l_suppkey AS b FROM lineitem WHERE l_discount > 0.09) ON a = b",
)
def id_match(spark, d):
    li = table(spark, d, "lineitem")
    return sets.id_match(li.where("l_quantity > 49"), li.where("l_discount > 0.09"), "l_suppkey")


@register("u5_label_union", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS labels FROM lineitem GROUP BY l_orderkey")
def label_union(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat_ws(",", F.array_sort(F.collect_set("l_returnflag"))).alias("labels"))


@register("u6_only_in_one", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
def only_in_one(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@register("u8_concat_by_key", "SELECT o_custkey, array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey), ';') AS keys FROM orders GROUP BY o_custkey")
def concat_by_key(spark, d):
    own = F.array_sort(F.collect_list("o_orderkey")).cast("array<string>")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.concat_ws(";", own).alias("keys"))


@register("u9_fold_concat", "SELECT o_orderkey FROM orders WHERE o_orderkey % 5 IN (1, 3)")
def fold_concat(spark, d):
    return table(spark, d, "orders").withColumn("fold", F.col("o_orderkey") % 5).where(F.col("fold").isin(1, 3)).select("o_orderkey")
