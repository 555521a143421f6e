"""Region statistics, label choice, volumes, boxes, percentiles and intensity scaling."""

from pyspark.sql import functions as F

from volspark.operators import regions as R
from volspark.queries.fixtures import (
    BAG, BAG_VOX, EV, LV, bag, bag_groups, bag_headers, bag_lut, ev, ev_dims, lv, with_,
)
from volspark.queries.registry import query


def rounded(df, *names, digits=6):
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


STATS = ("volume", "v_mean", "v_std", "v_min", "v_max", "v_range")

BASIC = f"""p AS (SELECT subject_id, seg, count(*) AS n_voxels, avg(norm) AS v_mean, stddev_samp(norm) AS v_std,
   min(norm) AS v_min, max(norm) AS v_max, sum(norm) AS v_sum, sum(norm*norm) AS v_sum2 FROM bag GROUP BY 1,2),
pv AS (SELECT *, n_voxels*({BAG_VOX}) AS volume FROM p)"""


@query("region_stats_basic", with_(BAG, BASIC, body="""
SELECT subject_id, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY seg) AS INT) AS row_index, seg, n_voxels, volume,
  coalesce(n_name,'Unknown-Label') AS struct_name, round(v_mean,6) AS v_mean, round(v_std,4) AS v_std, v_min, v_max,
  round(v_max-v_min,6) AS v_range
FROM pv LEFT JOIN nation ON seg = n_nationkey"""))
def region_stats_basic(spark, d):
    stats = R.with_volume(R.region_partials(bag(spark, d)), bag_headers(spark, d))
    named = R.with_names(R.stat_columns(stats), bag_lut(spark, d))
    out = rounded(R.with_index(named), "v_mean", "v_range").withColumn("v_std", F.round("v_std", 4))
    return out.select(*R.STAT_COLUMNS)


@query("region_stats_full", with_(BAG, BASIC, f"""
ids AS (SELECT s.subject_id, n_nationkey AS seg FROM (SELECT DISTINCT subject_id FROM bag) s, nation WHERE n_nationkey <> 7),
labelled AS (SELECT subject_id, seg, coalesce(n_voxels,0) n_voxels, coalesce(volume,0) volume, coalesce(v_mean,0) v_mean,
  CASE WHEN n_voxels IS NULL THEN 0 ELSE v_std END v_std, coalesce(v_min,0) v_min, coalesce(v_max,0) v_max
  FROM ids LEFT JOIN pv USING (subject_id, seg)),
found AS (SELECT subject_id, 10000+n_regionkey AS seg, CAST(sum(n_voxels) AS BIGINT) n_voxels, sum(volume) volume,
  sum(v_sum)/sum(n_voxels) v_mean,
  sqrt(greatest(sum(v_sum2 - v_sum*v_sum/n_voxels),0)/(sum(n_voxels)-1)) v_std, min(v_min) v_min, max(v_max) v_max
  FROM pv JOIN nation ON seg=n_nationkey GROUP BY 1,2),
merged AS (SELECT s.subject_id, g.seg, coalesce(n_voxels,0) n_voxels, coalesce(volume,0) volume, coalesce(v_mean,0) v_mean,
  CASE WHEN n_voxels IS NULL THEN 0 ELSE v_std END v_std, coalesce(v_min,0) v_min, coalesce(v_max,0) v_max
  FROM (SELECT DISTINCT subject_id FROM bag) s CROSS JOIN (SELECT DISTINCT 10000+n_regionkey AS seg FROM nation) g
  LEFT JOIN found f ON f.subject_id=s.subject_id AND f.seg=g.seg),
al AS (SELECT * FROM labelled UNION ALL SELECT * FROM merged)""", body="""
SELECT subject_id, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY seg) AS INT) AS row_index, CAST(seg AS INT) AS seg,
  n_voxels, volume, CASE WHEN seg >= 10000 THEN 'Merged-Label-'||seg ELSE coalesce(n_name,'Unknown-Label') END AS struct_name,
  round(v_mean,6) AS v_mean, round(v_std,4) AS v_std, v_min, v_max, round(v_max-v_min,6) AS v_range
FROM al LEFT JOIN nation ON seg = n_nationkey"""))
def region_stats_full(spark, d):
    out = R.region_stats(
        bag(spark, d), bag_headers(spark, d), bag_lut(spark, d), bag_groups(spark, d), exclude=[7], report_empty=True
    )
    return rounded(out, "v_mean", "v_range").withColumn("v_std", F.round("v_std", 4))


@query("region_stats_robust", with_(BAG, """
r AS (SELECT subject_id, seg, norm, row_number() OVER (PARTITION BY subject_id, seg ORDER BY norm) rk,
  count(*) OVER (PARTITION BY subject_id, seg) n FROM bag),
k AS (SELECT * FROM r WHERE rk > floor(((1.0::DOUBLE-0.8::DOUBLE)/2)*n) AND rk <= n - floor(((1.0::DOUBLE-0.8::DOUBLE)/2)*n))""", body="""
SELECT subject_id, seg, max(n) AS n_voxels, count(*) AS n_values, min(norm) AS v_min, max(norm) AS v_max,
  round(avg(norm),6) AS v_mean, round(stddev_samp(norm),3) AS v_std FROM k GROUP BY 1,2"""))
def region_stats_robust(spark, d):
    out = R.stat_columns(R.robust_partials(bag(spark, d), 0.8))
    return out.select(
        "subject_id", "seg", "n_voxels", "n_values", "v_min", "v_max",
        F.round("v_mean", 6).alias("v_mean"), F.round("v_std", 3).alias("v_std"),
    )


@query("merged_label_stats", with_(BAG, BASIC, body="""
SELECT subject_id, CAST(10000+n_regionkey AS INT) AS seg, CAST(sum(n_voxels) AS BIGINT) AS n_voxels, sum(volume) AS volume,
  round(sum(v_sum)/sum(n_voxels),6) AS v_mean,
  round(sqrt(greatest(sum(v_sum2 - v_sum*v_sum/n_voxels),0)/(sum(n_voxels)-1)),4) AS v_std, min(v_min) AS v_min, max(v_max) AS v_max
FROM pv JOIN nation ON seg=n_nationkey GROUP BY 1,2"""))
def merged_label_stats(spark, d):
    partials = R.with_volume(R.region_partials(bag(spark, d)), bag_headers(spark, d))
    out = R.stat_columns(R.merge_groups(partials, bag_groups(spark, d)))
    return out.select(
        "subject_id", "seg", "n_voxels", "volume", F.round("v_mean", 6).alias("v_mean"),
        F.round("v_std", 4).alias("v_std"), "v_min", "v_max",
    )


@query("distinct_label_groups", """
WITH g AS (SELECT c_nationkey AS group_id, c_custkey%3 AS m FROM customer),
s AS (SELECT group_id, list_sort(list_distinct(list(m))) AS members FROM g GROUP BY 1),
f AS (SELECT members, min(group_id) AS first_group FROM s GROUP BY 1)
SELECT CAST(9999 + row_number() OVER (ORDER BY first_group) AS INT) AS group_id, first_group,
  array_to_string(members, ',') AS members FROM f""")
def distinct_label_groups(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet")
    groups = rows.select(F.col("c_nationkey").alias("group_id"), (F.col("c_custkey") % 3).alias("member_id"))
    out = R.distinct_groups(groups)
    return out.withColumn("members", F.array_join(F.transform("members", lambda m: m.cast("string")), ","))


@query("report_empty_labels", with_(BAG, body="""
SELECT s.subject_id, n_nationkey+10 AS seg, coalesce(c,0) AS n_voxels
FROM (SELECT DISTINCT subject_id FROM bag) s CROSS JOIN nation
LEFT JOIN (SELECT subject_id, seg, count(*) c FROM bag GROUP BY 1,2) b ON b.subject_id=s.subject_id AND b.seg=n_nationkey+10"""))
def report_empty_labels(spark, d):
    counts = bag(spark, d).groupBy("subject_id", "seg").agg(F.count(F.lit(1)).alias("n_voxels"))
    ids = [i + 10 for i in R.label_ids(bag_lut(spark, d))]
    return R.fill_labels(counts, bag_headers(spark, d), ids, ["n_voxels"])


@query("drop_empty_keep_ids", with_(BAG, """
c AS (SELECT s.subject_id, n_nationkey+10 AS seg, coalesce(c,0) AS n_voxels
FROM (SELECT DISTINCT subject_id FROM bag) s CROSS JOIN nation
LEFT JOIN (SELECT subject_id, seg, count(*) c FROM bag GROUP BY 1,2) b ON b.subject_id=s.subject_id AND b.seg=n_nationkey+10)""", body="""
SELECT *, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY seg) AS INT) AS row_index FROM c WHERE n_voxels <> 0 OR seg IN (31, 33)"""))
def drop_empty_keep_ids(spark, d):
    return R.with_index(R.drop_empty(report_empty_labels(spark, d), keep=[31, 33]))


@query("choose_labels_excluding", with_(BAG, body="""
SELECT subject_id, seg, count(*) AS n FROM bag WHERE seg IN (SELECT n_nationkey FROM nation) AND seg NOT IN (0, 5) GROUP BY 1,2"""))
def choose_labels_excluding(spark, d):
    labels = R.choose_labels(bag(spark, d), lut=bag_lut(spark, d), exclude=[0, 5])
    return bag(spark, d).filter(R.is_in("seg", labels)).groupBy("subject_id", "seg").agg(F.count(F.lit(1)).alias("n"))


@query("label_membership", with_(BAG, body="""
SELECT subject_id, count(*) FILTER (seg IN (2,3,41)) AS inside, count(*) FILTER (seg NOT IN (2,3,41)) AS outside,
 CAST(0 AS BIGINT) AS inside_empty, count(*) AS outside_empty FROM bag GROUP BY 1"""))
def label_membership(spark, d):
    return bag(spark, d).groupBy("subject_id").agg(
        F.count_if(R.is_in("seg", [2, 3, 41])).alias("inside"),
        F.count_if(R.not_in("seg", [2, 3, 41])).alias("outside"),
        F.count_if(R.is_in("seg", [])).alias("inside_empty"),
        F.count_if(R.not_in("seg", [])).alias("outside_empty"),
    )


@query("intensity_preparation", with_(EV, body="""
SELECT subject_id, x, y, z, round(sqrt(abs(norm/4.0)*abs(norm/4.0)),6) AS v FROM ev"""))
def intensity_preparation(spark, d):
    v = R.prepare_intensity("norm", ["sqrt", "mul=2", "sqr", "div=4", "abs"])
    return ev(spark, d).select("subject_id", "x", "y", "z", F.round(v, 6).alias("v"))


@query("mask_volume", with_(BAG, body=f"""
SELECT subject_id, count(*) FILTER (norm > 50000) AS n_voxels, count(*) FILTER (norm > 50000)*({BAG_VOX}) AS volume FROM bag GROUP BY 1"""))
def mask_volume(spark, d):
    return R.mask_volume(bag(spark, d), bag_headers(spark, d), R.above("norm", 50000))


@query("class_volume", with_(BAG, body=f"""
SELECT subject_id, count(*) FILTER (seg IN (2,3,7,8,28))*({BAG_VOX}) AS value FROM bag GROUP BY 1"""))
def class_volume(spark, d):
    partials = R.with_volume(R.region_partials(bag(spark, d)), bag_headers(spark, d))
    return R.class_volume(partials, [2, 3, 7, 8, 28])


@query("label_centroids", with_(EV, body="""
SELECT subject_id, seg, count(*) AS n, round(avg(x),6) AS cx, round(avg(y),6) AS cy, round(avg(z),6) AS cz FROM ev WHERE seg > 0 GROUP BY 1,2"""))
def label_centroids(spark, d):
    return rounded(R.centroids(ev(spark, d).filter("seg > 0")), "cx", "cy", "cz")


@query("bounding_boxes", with_(LV, body="""
SELECT subject_id, seg, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z
FROM lv GROUP BY 1,2"""))
def bounding_boxes(spark, d):
    return R.bounding_boxes(lv(spark, d), ["subject_id", "seg"])


@query("box_offsets", with_(EV, body="""
SELECT subject_id, CAST(least(greatest(0, round_even((min(x)+max(x))/2.0-2.5,0)), 3) AS INT) AS off_x,
 CAST(least(greatest(0, round_even((min(y)+max(y))/2.0-2,0)), 4) AS INT) AS off_y,
 CAST(least(greatest(0, round_even((min(z)+max(z))/2.0-15.5,0)), 69) AS INT) AS off_z FROM ev WHERE seg >= 4 GROUP BY 1"""))
def box_offsets(spark, d):
    return R.box_offsets(R.bounding_boxes(ev(spark, d).filter("seg >= 4")), ev_dims(spark, d), (5, 4, 31))


@query("distinct_labels", with_(LV, body="SELECT DISTINCT subject_id, seg FROM lv"))
def distinct_labels(spark, d):
    return R.distinct_labels(lv(spark, d))


@query("label_bincount_2d", with_(LV, body="SELECT seg, pred, count(*) AS n FROM lv GROUP BY 1,2"))
def label_bincount_2d(spark, d):
    return lv(spark, d).groupBy("seg", "pred").agg(F.count(F.lit(1)).alias("n"))


@query("region_percentiles", with_(BAG, body="""
SELECT subject_id, seg, round(quantile_cont(norm, 0.01),6) AS p01, round(quantile_cont(norm, 0.5),6) AS p50, round(quantile_cont(norm, 0.9),6) AS p90
FROM bag GROUP BY 1,2"""))
def region_percentiles(spark, d):
    out = R.region_percentiles(bag(spark, d), {"p01": 0.01, "p50": 0.5, "p90": 0.9}, by=("subject_id", "seg"))
    return rounded(out, "p01", "p50", "p90")


BALL = """c AS (SELECT subject_id, avg(x) cx, avg(y) cy, avg(z) cz FROM ev GROUP BY 1),
b AS (SELECT e.* FROM ev e JOIN c USING (subject_id) WHERE (x-cx)*(x-cx)+(y-cy)*(y-cy)+4*(z-cz)*(z-cz) < 225),
q AS (SELECT subject_id, quantile_cont(norm,0.01) s0, quantile_cont(norm,0.9) s1 FROM b GROUP BY 1)"""


@query("ball_normalise", with_(EV, BALL, body="""
SELECT subject_id, x, y, z, round(3 + (110-3)/(s1-s0)*(norm-s0), 5) AS mapped FROM ev JOIN q USING (subject_id)"""))
def ball_normalise(spark, d):
    out = R.ball_normalise(ev(spark, d), 15.0, (1.0, 1.0, 2.0))
    return out.select("subject_id", "x", "y", "z", F.round("mapped", 5).alias("mapped"))


@query("white_matter_normalise", with_(EV, """
q AS (SELECT subject_id, quantile_cont(norm,0.01) s0, avg(norm) FILTER (seg IN (2,4)) s1 FROM ev GROUP BY 1)""", body="""
SELECT subject_id, x, y, z, round(3 + (110-3)/(s1-s0)*(norm-s0), 5) AS mapped FROM ev JOIN q USING (subject_id)"""))
def white_matter_normalise(spark, d):
    out = R.white_matter_normalise(ev(spark, d), white=(2, 4))
    return out.select("subject_id", "x", "y", "z", F.round("mapped", 5).alias("mapped"))


@query("intensity_map_masked", with_(EV, """
q AS (SELECT subject_id, min(norm) s0, max(norm) s1 FROM ev GROUP BY 1),
m AS (SELECT subject_id, x, y, z, seg, -2 + (10.0+2)/(s1-s0)*(norm-s0) AS v FROM ev JOIN q USING (subject_id))""", body="""
SELECT subject_id, x, y, z, round(CASE WHEN seg<>0 AND v<1 THEN v+1 ELSE v END, 6) AS mapped FROM m"""))
def intensity_map_masked(spark, d):
    v = ev(spark, d)
    pairs = v.groupBy("subject_id").agg(F.min("norm").alias("s0"), F.max("norm").alias("s1"))
    pairs = pairs.select("*", F.lit(-2.0).alias("t0"), F.lit(10.0).alias("t1"))
    out = R.map_intensity(v, pairs, mask="seg")
    return out.select("subject_id", "x", "y", "z", F.round("mapped", 6).alias("mapped"))


@query("mean_in_mask", with_(EV, body="SELECT subject_id, round(avg(norm) FILTER (seg > 1),6) AS m FROM ev GROUP BY 1"))
def mean_in_mask(spark, d):
    return ev(spark, d).groupBy("subject_id").agg(F.round(F.avg(F.when(F.col("seg") > 1, F.col("norm"))), 6).alias("m"))


SCALE = """st AS (SELECT subject_id, min(norm) lo, max(norm) hi, count(*) total, count(*) FILTER (abs(norm)>=1e-15) nz FROM ev GROUP BY 1),
g0 AS (SELECT e.*, lo, hi, (hi-lo)/1000 AS step, least(floor((norm-lo)*1000/(hi-lo)),999) AS g FROM ev e JOIN st USING (subject_id)),
b AS (SELECT subject_id, CAST(g - (norm < lo+g*step)::INT + (norm >= lo+(g+1)*step AND g < 999)::INT AS INT) AS bin FROM g0),
grid AS (SELECT subject_id, unnest(range(0,1000)) AS bin FROM st),
h AS (SELECT grid.subject_id, grid.bin, count(b.bin) AS n FROM grid LEFT JOIN b ON b.subject_id=grid.subject_id AND b.bin=grid.bin GROUP BY 1,2),
ch AS (SELECT subject_id, bin+1 AS j, sum(n) OVER (PARTITION BY subject_id ORDER BY bin) AS c FROM h UNION ALL SELECT subject_id, 0, 0 FROM st),
ed AS (SELECT subject_id, max(j) FILTER (c < floor(0.01::DOUBLE*total)) + 1 AS lj, min(j) FILTER (c >= total - floor((1-0.98::DOUBLE)*nz)) - 2 AS hj,
  any_value(lo) lo, any_value(hi) hi FROM ch JOIN st USING (subject_id) GROUP BY 1),
sc AS (SELECT subject_id, lo+lj*(hi-lo)/1000 AS src_min, 255.0/((lo+hj*(hi-lo)/1000)-(lo+lj*(hi-lo)/1000)) AS scale FROM ed)"""


@query("histogram_scale", with_(EV, SCALE, body="SELECT subject_id, round(src_min,6) AS src_min, round(scale,5) AS scale FROM sc"))
def histogram_scale(spark, d):
    out = R.intensity_scale(ev(spark, d), 0, 255, 0.01, 0.98)
    return out.select("subject_id", F.round("src_min", 6).alias("src_min"), F.round("scale", 5).alias("scale"))


@query("rescale_and_clip", with_(EV, SCALE, body="""
SELECT subject_id, x, y, z, CASE WHEN norm=0 THEN 0 ELSE round_even(greatest(0, least(255, scale*(norm-src_min))),0) END AS scaled
FROM ev JOIN sc USING (subject_id)"""))
def rescale_and_clip(spark, d):
    return R.rescale(ev(spark, d), 0, 255, 0.01, 0.98).select("subject_id", "x", "y", "z", "scaled")


WIDE_EV = "evw AS (SELECT subject_id, x, y, z, norm*1000 AS norm FROM ev)"


@query("rescale_wide", with_(EV, WIDE_EV, SCALE.replace("FROM ev", "FROM evw"), "wd AS (SELECT subject_id FROM evw WHERE subject_id%2=0 GROUP BY 1 HAVING max(norm) > 255)", body="""
SELECT v.subject_id, x, y, z, CASE WHEN wd.subject_id IS NULL THEN norm WHEN norm=0 THEN 0 ELSE round_even(greatest(0, least(255, scale*(norm-src_min))),0) END AS scaled
FROM evw v JOIN sc USING (subject_id) LEFT JOIN wd USING (subject_id)"""))
def rescale_wide(spark, d):
    v = ev(spark, d).select("subject_id", "x", "y", "z", (F.col("norm") * 1000).alias("norm"))
    kinds = ev_dims(spark, d).select("subject_id", F.when(F.col("subject_id") % 2 == 0, "float32").otherwise("uint8").alias("dtype"))
    return R.rescale_wide(v, kinds, 0, 255, 0.01, 0.98).select("subject_id", "x", "y", "z", "scaled")


@query("min_max_normalise", with_(EV, """q AS (SELECT subject_id, min(norm) lo, max(norm) hi FROM ev GROUP BY 1)""", body="""
SELECT subject_id, x, y, z, round((norm-lo)/(hi-lo),6) AS unit FROM ev JOIN q USING (subject_id)"""))
def min_max_normalise(spark, d):
    return R.min_max_normalise(ev(spark, d)).select("subject_id", "x", "y", "z", F.round("unit", 6).alias("unit"))


@query("divide_by_max", with_(LV, "q AS (SELECT subject_id, max(norm) hi FROM lv GROUP BY 1)", body="""
SELECT subject_id, x, y, z, round(norm/hi,6) AS unit FROM lv JOIN q USING (subject_id)"""))
def divide_by_max(spark, d):
    return R.divide_by_max(lv(spark, d)).select("subject_id", "x", "y", "z", F.round("unit", 6).alias("unit"))


@query("byte_normalise", with_(LV, body="SELECT subject_id, x, y, z, round(greatest(0,least(1,norm/300/255.0)),6) AS unit FROM lv"))
def byte_normalise(spark, d):
    v = lv(spark, d).withColumn("norm", F.col("norm") / 300)
    return v.select("subject_id", "x", "y", "z", F.round(R.byte_normalise("norm"), 6).alias("unit"))


@query("median_frequency_weights", with_(EV, "c AS (SELECT subject_id, seg, count(*) n FROM ev GROUP BY 1,2)", body="""
SELECT subject_id, seg, n, round(least(median(n) OVER (PARTITION BY subject_id)/n, 5),6) AS weight FROM c"""))
def median_frequency_weights(spark, d):
    return rounded(R.class_weights(ev(spark, d)), "weight")


@query("class_median_mad", with_(EV, """
r AS (SELECT subject_id, seg//2 AS cls, norm FROM ev WHERE seg//2=0 OR norm > 0),
m AS (SELECT subject_id, cls, median(norm) AS md FROM r GROUP BY 1,2)""", body="""
SELECT subject_id, CAST(cls AS INT) AS cls, round(any_value(md),6) AS median, round(median(abs(norm-md)),6) AS mad FROM r JOIN m USING (subject_id, cls) GROUP BY 1,2"""))
def class_median_mad(spark, d):
    v = ev(spark, d)
    classes = v.select("seg").distinct().select("seg", F.floor(F.col("seg") / 2).cast("int").alias("cls"))
    return rounded(R.class_median_mad(v, classes), "median", "mad")
