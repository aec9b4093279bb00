"""Array, map and distribution queries."""

from pyspark.sql import functions as F

from scanloom.functions import arrays as a
from scanloom.operators import distances

from .registry import register, table


_Q = "SELECT l_orderkey, list(CAST(l_quantity AS INTEGER) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS q FROM lineitem GROUP BY 1"


@register(
    "f26_pad_crop",
    f"""SELECT l_orderkey, array_to_string([0, 0] || q, ',') AS padded, array_to_string(q[2:3], ',') AS cropped,
  array_to_string(CASE WHEN len(q) <= 5 THEN list_resize([]::INTEGER[], (5 - len(q)) // 2, 0) || q || list_resize([]::INTEGER[], 5 - len(q) - (5 - len(q)) // 2, 0)
  ELSE q[len(q) // 2 - 1:len(q) // 2 + 3] END, ',') AS centred FROM ({_Q})""",
)
def pad_crop(spark, d):
    own = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    q = table(spark, d, "lineitem").groupBy("l_orderkey").agg(own.alias("r")).select("l_orderkey", F.col("r.l_quantity").cast("array<double>").alias("q"))
    text = lambda x: F.concat_ws(",", x.cast("array<int>").cast("array<string>"))
    c = F.col("q")
    return q.select("l_orderkey", text(a.pad_array(c, 2, 0)).alias("padded"), text(a.crop_array(c, 1, 2)).alias("cropped"), text(a.centre_array(c, 5)).alias("centred"))


@register("f29_value_places", "SELECT l_orderkey, array_to_string(list(CAST(p - 1 AS VARCHAR) ORDER BY p) FILTER (WHERE l_returnflag = 'A'), ',') AS places FROM (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS p FROM lineitem) GROUP BY 1 HAVING count(*) FILTER (WHERE l_returnflag = 'A') > 0")
def value_places(spark, d):
    r = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(r.alias("r"))
    p = g.select("l_orderkey", a.where_equal(F.col("r.l_returnflag"), F.lit("A")).alias("p")).where("size(p) > 0")
    return p.select("l_orderkey", F.concat_ws(",", F.col("p").cast("array<string>")).alias("places"))


@register("f34_boxes", "SELECT l_orderkey, l_linenumber, round(l_quantity + 5, 4) AS cx, round(l_discount * 10 + 2, 4) AS cy, 40.0 AS area FROM lineitem")
def boxes(spark, d):
    x0, y0 = F.col("l_quantity"), F.col("l_discount") * 10
    c = a.corners_to_centre(x0, y0, x0 + 10, y0 + 4)
    area = a.box_area(F.lit(0.0), F.lit(0.0), c["w"], c["h"])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(c["cx"], 4).alias("cx"), F.round(c["cy"], 4).alias("cy"), F.round(area, 4).alias("area"))


@register("f37_collate", "SELECT user_id, count(*) AS n, sum(CAST(place AS BIGINT)) AS places, round(sum(value), 4) AS total FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events) GROUP BY 1")
def collate(spark, d):
    e = a.collated(table(spark, d, "events"), ["user_id"], ["value", "event_type"], "event_id")
    back = a.decollated(e, ["user_id"], ["value", "event_type"])
    return back.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("place").alias("places"), F.round(F.sum("value"), 4).alias("total"))


@register("o10_sorted_map", "SELECT p_partkey, array_to_string(list_sort([p_type || ':1', p_brand || ':' || p_size, 'N' || p_partkey || ':3']), ',') AS entries FROM part")
def sorted_map(spark, d):
    p = table(spark, d, "part")
    m = a.sorted_map(F.create_map("p_type", F.lit(1), "p_brand", F.col("p_size").cast("int"), F.concat(F.lit("N"), F.col("p_partkey").cast("string")), F.lit(3)))
    return p.select("p_partkey", F.concat_ws(",", F.transform(m, lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))).alias("entries"))


@register("s31_latest_version", "SELECT 'v' || max(p_size) || '.' || max_by(p_partkey % 13, p_size * 1000 + p_partkey % 13) AS latest FROM part")
def latest_version(spark, d):
    v = F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 13).cast("string"))
    return table(spark, d, "part").select(v.alias("v")).agg(F.max_by("v", a.numeric_version(F.col("v"))).alias("latest"))


@register("s32_existence_audit", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) AS expected FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderstatus = 'F') < count(*)")
def audit(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count("*").alias("expected"))
    return g.where("done < expected")


@register("s17_first_per_modality", "SELECT p_brand, min(p_name) FILTER (WHERE p_type = 'ECONOMY') AS economy, min(p_name) FILTER (WHERE p_type = 'PROMO') AS promo FROM part GROUP BY 1")
def first_per(spark, d):
    pick = lambda k: F.min(F.when(F.col("p_type") == k, F.col("p_name")))
    return table(spark, d, "part").groupBy("p_brand").agg(pick("ECONOMY").alias("economy"), pick("PROMO").alias("promo"))


@register("x5_named_aggregates", "SELECT event_type, round(avg(value), 6) AS value_mean, max(value) AS value_max, round(max(value) - min(value), 6) AS value_span FROM events GROUP BY 1")
def named(spark, d):
    out = distances.summarised(table(spark, d, "events"), ["event_type"], ["value"], ["mean", "max", "span"], {"span": lambda c: F.max(c) - F.min(c)})
    return out.withColumns({c: F.round(c, 6) for c in ("value_mean", "value_span")})


@register("a44_prediction_variance", "SELECT user_id, round(avg(v), 5) AS variance FROM (SELECT user_id, event_type, var_pop(value) AS v FROM events GROUP BY 1, 2) GROUP BY 1")
def variance(spark, d):
    e = table(spark, d, "events").withColumnRenamed("event_type", "place")
    return distances.sample_variance(e, ["user_id"], "value").withColumn("variance", F.round("variance", 5))


@register("a44_linear_mmd", "SELECT round((avg(l_discount) FILTER (WHERE l_returnflag = 'A') - avg(l_discount) FILTER (WHERE l_returnflag = 'R')) ** 2 + (avg(l_tax) FILTER (WHERE l_returnflag = 'A') - avg(l_tax) FILTER (WHERE l_returnflag = 'R')) ** 2, 9) AS mmd FROM lineitem")
def mmd(spark, d):
    li = table(spark, d, "lineitem")
    v = distances.linear_mmd(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"), ["l_discount", "l_tax"])
    return spark.createDataFrame([(v,)], "mmd double").select(F.round("mmd", 9).alias("mmd"))


@register("a53_fold_merge", "SELECT o_orderkey, CAST(o_orderkey % 3 AS INTEGER) AS fold FROM orders")
def fold_merge(spark, d):
    from scanloom.operators.sets import union_unique

    o = table(spark, d, "orders").select("o_orderkey")
    return union_unique("o_orderkey", *(o.where(F.col("o_orderkey") % 3 == k).withColumn("fold", F.lit(k)) for k in range(3)))
