"""Training slices, augmentation, template averages and streaming jobs."""

from pyspark.sql import functions as F

from volspark.operators import regions as R
from volspark.operators import training as T
from volspark.operators.labels import VOXEL
from volspark.queries.fixtures import BAG, BAG_VOX, EV, LINES, LV, STAGES, bag_headers, ev, ev_dims, ev_stored, lv, table, with_
from volspark.queries.grid_ops import CLOSED, cube, eroded
from volspark.queries.region_tables import rounded
from volspark.queries.registry import query
from volspark.queries.text_ops import HIT, scratch
from volspark.sources.manifest import read_slabs, write_slabs
from volspark.streaming import live as S

GRAD = """gr AS (SELECT a.subject_id, a.x, a.y, a.z, (coalesce(x1.blk,a.blk)<>coalesce(x0.blk,a.blk)) OR (coalesce(y1.blk,a.blk)<>coalesce(y0.blk,a.blk)) OR (coalesce(z1.blk,a.blk)<>coalesce(z0.blk,a.blk)) AS g
FROM ev a LEFT JOIN ev x0 ON x0.subject_id=a.subject_id AND x0.x=a.x-1 AND x0.y=a.y AND x0.z=a.z LEFT JOIN ev x1 ON x1.subject_id=a.subject_id AND x1.x=a.x+1 AND x1.y=a.y AND x1.z=a.z
LEFT JOIN ev y0 ON y0.subject_id=a.subject_id AND y0.x=a.x AND y0.y=a.y-1 AND y0.z=a.z LEFT JOIN ev y1 ON y1.subject_id=a.subject_id AND y1.x=a.x AND y1.y=a.y+1 AND y1.z=a.z
LEFT JOIN ev z0 ON z0.subject_id=a.subject_id AND z0.x=a.x AND z0.y=a.y AND z0.z=a.z-1 LEFT JOIN ev z1 ON z1.subject_id=a.subject_id AND z1.x=a.x AND z1.y=a.y AND z1.z=a.z+1)"""
WEIGHTS = (
    cube(1), "m AS (SELECT * FROM ev WHERE blk > 2)", *CLOSED[1:], "k AS (SELECT subject_id, x, y, z FROM m)",
    "df AS ((FROM c EXCEPT FROM k) UNION ALL (FROM k EXCEPT FROM c))", "mb AS (SELECT * FROM ev WHERE blk >= 1)",
    f"er AS ({eroded('mb', 3, 27)})", "cb AS (SELECT subject_id, x, y, z FROM ev WHERE blk > 2 EXCEPT FROM er)", GRAD,
    "cc AS (SELECT subject_id, blk, count(*) n FROM ev GROUP BY 1,2)", "cw AS (SELECT *, least(median(n) OVER (PARTITION BY subject_id)/n, 5) AS w FROM cc)",
    """vw AS (SELECT e.subject_id, e.x, e.y, e.z, e.blk, e.norm, w + CASE WHEN g THEN 5 ELSE 0 END + CASE WHEN df.x IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN cb.x IS NOT NULL THEN 2 ELSE 0 END AS weight
 FROM ev e JOIN cw USING (subject_id, blk) JOIN gr USING (subject_id, x, y, z) LEFT JOIN df USING (subject_id, x, y, z) LEFT JOIN cb USING (subject_id, x, y, z))""",
)


def weighted(spark, d, **more):
    v = ev(spark, d).select(*VOXEL, "norm", "blk")
    return T.voxel_weights(v, ev_stored(spark, d), "blk", hires_weight=5, threshold=2, **more)


@query("voxel_weights", with_(EV, *WEIGHTS, body="SELECT subject_id, x, y, z, blk, round(weight,6) AS weight FROM vw"))
def voxel_weights(spark, d):
    return rounded(weighted(spark, d), "weight").select(*VOXEL, "blk", "weight")


@query("slice_weights", with_(EV, "cc AS (SELECT subject_id, blk, count(*) n FROM ev GROUP BY 1,2)", "cw AS (SELECT *, least(median(n) OVER (PARTITION BY subject_id)/n, 5) AS w FROM cc)", body="""
SELECT a.subject_id, a.x, a.y, a.z, a.blk, round(w + CASE WHEN (coalesce(x1.blk,a.blk)<>coalesce(x0.blk,a.blk)) OR (coalesce(y1.blk,a.blk)<>coalesce(y0.blk,a.blk)) THEN 5 ELSE 0 END,6) AS weight FROM ev a JOIN cw USING (subject_id, blk)
LEFT JOIN ev x0 ON x0.subject_id=a.subject_id AND x0.x=a.x-1 AND x0.y=a.y AND x0.z=a.z LEFT JOIN ev x1 ON x1.subject_id=a.subject_id AND x1.x=a.x+1 AND x1.y=a.y AND x1.z=a.z
LEFT JOIN ev y0 ON y0.subject_id=a.subject_id AND y0.x=a.x AND y0.y=a.y-1 AND y0.z=a.z LEFT JOIN ev y1 ON y1.subject_id=a.subject_id AND y1.x=a.x AND y1.y=a.y+1 AND y1.z=a.z"""))
def slice_weights(spark, d):
    v = ev(spark, d).select(*VOXEL, "blk")
    return rounded(T.slice_weights(v, R.class_weights(v, 5.0, "blk"), "blk"), "weight")


@query("training_slabs", with_(EV, *WEIGHTS, """pl AS (SELECT subject_id, z AS x, x AS y, y AS z, blk, norm, weight FROM vw)""", body="""
SELECT a.subject_id, a.z AS slice, a.x AS u, a.y AS v, a.blk AS label, round(a.weight,6) AS weight, p.norm AS s0, a.norm AS s1, n.norm AS s2 FROM pl a
JOIN pl p ON p.subject_id=a.subject_id AND p.x=a.x AND p.y=a.y AND p.z=greatest(a.z-1,0) JOIN pl n ON n.subject_id=a.subject_id AND n.x=a.x AND n.y=a.y AND n.z=least(a.z+1,7)
WHERE (a.subject_id, a.z) IN (SELECT (subject_id, z) FROM pl GROUP BY subject_id, z HAVING sum(blk) > 1500)"""))
def training_slabs(spark, d):
    v = ev(spark, d).select(*VOXEL, "norm", F.col("blk").alias("seg"))
    slabs = T.build_slabs(v, ev_dims(spark, d), "axial", 1, 1500, hires_weight=5, threshold=2)
    path = scratch(spark, "slabs")
    write_slabs(slabs, path)
    got = read_slabs(spark, path, "axial", [100, 256])
    return got.select("subject_id", "slice", "u", "v", "label", F.round("weight", 6).alias("weight"), *(F.col("slab")[i].alias(f"s{i}") for i in range(3)))


SLAB_MAP = "mp AS (SELECT n_nationkey AS src, n_nationkey * 7 % 5 AS dst FROM nation WHERE n_nationkey < 20)"


@query("training_slabs_logged", with_(EV, SLAB_MAP, "lb AS (SELECT ev.*, blk + CASE WHEN subject_id % 5 = 3 AND seg = 3 THEN 17 ELSE 0 END AS l FROM ev WHERE NOT (subject_id % 5 = 4 AND z = 7))",
    "bad AS (SELECT subject_id, CASE WHEN subject_id % 5 = 2 THEN 'no image size' WHEN max(l) > 19 THEN 'label above the map: '||max(l) FILTER (l > 19) END AS reason FROM lb GROUP BY 1)",
    "gd AS (SELECT lb.subject_id, z, x, y, coalesce(dst, 0) AS m FROM lb JOIN bad USING (subject_id) LEFT JOIN mp ON src = l WHERE reason IS NULL)", body="""
SELECT subject_id, 'Failed: '||reason AS state, CAST(0 AS BIGINT) AS pixels, CAST(0 AS BIGINT) AS labels FROM bad WHERE reason IS NOT NULL UNION ALL
SELECT subject_id, 'ok', count(*), CAST(sum(m) AS BIGINT) FROM gd WHERE (subject_id, x) IN (SELECT (subject_id, x) FROM gd GROUP BY subject_id, x HAVING sum(m) > 1200) GROUP BY 1"""))
def training_slabs_logged(spark, d):
    """One subject has no size and one a label that the map does not know; the others are mapped and built."""
    k = F.col("subject_id") % 5
    label = F.col("blk") + F.when((k == 3) & (F.col("seg") == 3), 17).otherwise(0)
    v = ev(spark, d).filter(~((k == 4) & (F.col("z") == 7))).select(*VOXEL, "norm", label.cast("int").alias("seg"))
    n = F.col("n_nationkey")
    mapping = table(spark, d, "nation").filter(n < 20).select(n.cast("int").alias("src"), (n * 7 % 5).cast("int").alias("dst"))
    slabs, log = T.build_slabs_logged(v, ev_dims(spark, d).filter(k != 2), "sagittal", 1, 1200, mapping)
    built = slabs.groupBy("subject_id").agg(F.lit("ok").alias("state"), F.count(F.lit(1)).alias("pixels"), F.sum("label").cast("bigint").alias("labels"))
    none = F.lit(0).cast("bigint")
    return built.unionByName(log.select("subject_id", "state", none.alias("pixels"), none.alias("labels")))


@query("centre_crop", with_(EV, body="SELECT subject_id, CAST(x-2 AS INT) AS u, CAST(z-24 AS INT) AS v, y, blk FROM ev WHERE x BETWEEN 2 AND 5 AND z BETWEEN 24 AND 74"))
def centre_crop(spark, d):
    p = ev(spark, d).select("subject_id", F.col("x").alias("u"), F.col("z").alias("v"), "y", "blk")
    return T.crop_slices(p, (4, 51), F.lit(8), F.lit(100))


@query("random_crop")
def random_crop(spark, d):
    p = ev(spark, d).select("subject_id", F.col("x").alias("u"), F.col("z").alias("v"), "y", "blk")
    return T.crop_slices(p, (4, 51), F.lit(8), F.lit(100), "subject_id", 7)


@query("scale_jitter")
def scale_jitter(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.lit(1.0).alias("scale"))
    return e.select("vec_id", T.jitter("scale", "vec_id").alias("scale"))


@query("zoomed_scale", "SELECT c_custkey, round(1/CASE WHEN c_nationkey>0 AND c_custkey%2=0 THEN 0.5/c_nationkey ELSE 0.5 END,6) AS f0, round(1/CASE WHEN c_nationkey>0 AND c_custkey%2=0 THEN 0.25/2 ELSE 0.25 END,6) AS f1 FROM customer")
def zoomed_scale(spark, d):
    c = table(spark, d, "customer").select(
        "c_custkey", F.lit(0.5).alias("z0"), F.lit(0.25).alias("z1"), F.col("c_nationkey").cast("double").alias("a0"),
        F.when(F.col("c_custkey") % 2 == 0, 2.0).otherwise(0.0).alias("a1"),
    )
    f = T.zoomed_scale(["z0", "z1"], ["a0", "a1"])
    return c.select("c_custkey", F.round(f[0], 6).alias("f0"), F.round(f[1], 6).alias("f1"))


@query("flip_sides", with_(EV, body=f"SELECT subject_id, CAST(7-x AS INT) AS x, y, z, CAST(({T.FLIPPED_LABELS})[seg+label+1] AS INT) AS l FROM ev"))
def flip_sides(spark, d):
    v = ev(spark, d).select(*VOXEL, (F.col("seg") + F.col("label")).alias("l"))
    return T.flip_sides(v, ev_dims(spark, d), "x", "l")


@query("bias_field", with_(EV, body="""SELECT subject_id, x, y, z, round(exp(0.1+0.2*c+0.3*b+0.4*a),6) AS field FROM (SELECT *, (x-3.5)/3.5::DOUBLE AS a, (y-3.5)/3.5::DOUBLE AS b, (z-49.5)/49.5::DOUBLE AS c FROM ev)"""))
def bias_field(spark, d):
    v = ev(spark, d).select(*VOXEL, F.lit(8).alias("nx"), F.lit(8).alias("ny"), F.lit(100).alias("nz"), F.expr("array(0.1D, 0.2D, 0.3D, 0.4D)").alias("k"))
    return v.select(*VOXEL, F.round(T.bias_field(1, "k"), 6).alias("field"))


@query("synthetic_intensity")
def synthetic_intensity(spark, d):
    v = ev(spark, d).select(*VOXEL, "seg")
    classes = ev(spark, d).groupBy("seg").agg(F.avg("norm").alias("mean"), F.coalesce(F.stddev_samp("norm"), F.lit(0.0)).alias("std"))
    return T.synthetic_intensity(v, classes)


@query("join_modalities", "SELECT a.vec_id, array_to_string([a.label, a.label+1, b.label*2], ',') AS slab, 0.5::DOUBLE AS w1, 0.5::DOUBLE AS w2 FROM embeddings a JOIN embeddings b ON b.vec_id=a.vec_id+1")
def join_modalities(spark, d):
    e = table(spark, d, "embeddings")
    t1 = e.select("vec_id", F.array("label", F.col("label") + 1).alias("slab"))
    t2 = e.select((F.col("vec_id") - 1).alias("vec_id"), F.array(F.col("label") * 2).alias("slab"))
    out = T.join_modalities(t1, t2, ["vec_id"])
    return out.withColumn("slab", F.array_join(F.transform("slab", lambda v: v.cast("string")), ","))


@query("class_names", "SELECT CAST(CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 0 ELSE 1 END AS INT) AS option_no, c_custkey AS pos, c_name AS class_name FROM customer WHERE c_mktsegment IN ('HOUSEHOLD','MACHINERY') AND c_nationkey<12")
def class_names(spark, d):
    c = table(spark, d, "customer")
    space = F.when(F.col("c_nationkey") < 12, "sagittal").otherwise("not_sagittal")
    t = c.select(space.alias("space"), F.col("c_mktsegment").alias("option"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("class_name"))
    return T.class_names(t, "sagittal", ["HOUSEHOLD", "MACHINERY"])


@query("add_auxiliary", """SELECT l_orderkey AS k, false AS auxiliary FROM (SELECT DISTINCT l_orderkey FROM lineitem)
UNION ALL SELECT o_orderkey, true FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey)-1 AS p FROM orders) WHERE p%3=0""")
def add_auxiliary(spark, d):
    labelled = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    return T.add_auxiliary(labelled, table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), 0.3, "k")


@query("template_average", with_(EV, body="SELECT subject_id//3 AS base_id, x, y, z, round(avg(norm),6) AS mean, round(median(norm),6) AS median, max((seg>2)::INT) AS mask FROM ev GROUP BY 1,2,3,4"))
def template_average(spark, d):
    v = ev(spark, d).withColumn("base_id", F.floor(F.col("subject_id") / 3)).withColumn("mask", (F.col("seg") > 2).cast("int"))
    return rounded(T.template_average(v), "mean", "median")


@query("plot_slices", with_(LV, """g AS (SELECT subject_id, y AS x, x AS s, CASE WHEN x%4=0 THEN 1 WHEN x%4=1 THEN 150 WHEN x%4=2 AND y%8<4 THEN 10 ELSE seg+9 END AS l FROM lv),
sl AS (SELECT subject_id, s, min(l) lo, bool_or(l>100) co, bool_or(l<=2) op FROM g GROUP BY 1,2),
kd AS (SELECT subject_id, s, 'core' AS kind FROM sl WHERE co UNION ALL SELECT subject_id, s, 'optic' FROM sl WHERE op UNION ALL SELECT subject_id, s, 'other' FROM sl WHERE NOT co AND NOT op AND lo<>10)""", body="""
SELECT subject_id, s AS x, kind FROM kd QUALIFY (row_number() OVER (PARTITION BY subject_id, kind ORDER BY s)-1) % CASE kind WHEN 'core' THEN 1 WHEN 'optic' THEN 4 ELSE 2 END = 0"""))
def plot_slices(spark, d):
    x = F.col("x")
    label = F.when(x % 4 == 0, 1).when(x % 4 == 1, 150).when((x % 4 == 2) & (F.col("y") % 8 < 4), 10).otherwise(F.col("seg") + 9)
    return T.plot_slices(lv(spark, d).select("subject_id", "x", label.alias("seg")))


# --- streaming ---------------------------------------------------------------------------------------


def stream_of(spark, d, name):
    """The driver table as a file stream."""
    return S.file_stream(spark, f"{d}/[{name[0]}]{name[1:]}.parquet", table(spark, d, name).schema)


@query("stream_log_errors", with_(LINES, body=f"SELECT doc_id, line FROM lines WHERE {HIT}"))
def stream_log_errors(spark, d):
    docs = stream_of(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    out = scratch(spark, "errors")
    sink = S.live_errors(docs, ["sch"], ["the"]).writeStream.format("parquet").option("path", out)
    S.run_available(sink, scratch(spark, "progress"))
    return spark.read.schema("doc_id bigint, line string").parquet(out)


def status_stream(spark, d):
    return stream_of(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("subject_id"), "event_id", F.col("event_type").alias("stage"), F.when(F.col("value") > 50, "error").otherwise("ok").alias("state"))


@query("stream_stage_counters", "SELECT epoch(date_trunc('day', ts))::BIGINT AS day_start, event_type AS stage, count(*) AS n, count(*) FILTER (value > 50) AS n_failed FROM events GROUP BY 1,2")
def stream_stage_counters(spark, d):
    out = scratch(spark, "counters")
    sink = S.live_counters(status_stream(spark, d)).writeStream.outputMode("update").foreachBatch(S.upsert_counts(out))
    S.run_available(sink, scratch(spark, "progress"))
    rows = S.latest(spark.read.parquet(out), ["w", "stage"], ["n", "n_failed"])
    # windows start at whole days of the session time zone's epoch
    return rows.select(F.unix_timestamp("w.start").alias("day_start"), "stage", "n", "n_failed")


@query("stream_deduplicated", "SELECT DISTINCT event_id FROM events")
def stream_deduplicated(spark, d):
    rows = status_stream(spark, d).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(2))))
    out = scratch(spark, "once")
    sink = S.once_only(rows, ["event_id"]).select("event_id").writeStream.format("parquet").option("path", out)
    S.run_available(sink, scratch(spark, "progress"))
    return spark.read.schema("event_id bigint").parquet(out)


# A finite source arrives at once, so a group holds all starts of its subjects: about so many.
STAGE_GROUP_ROWS = 4096


@query("stream_stage_durations", with_(STAGES, body="SELECT * FROM (SELECT subject_id, event_id, stage, round((lead(us) OVER (PARTITION BY subject_id ORDER BY us, event_id)-us)/1e6,6) AS duration_s FROM stages) WHERE duration_s IS NOT NULL"))
def stream_stage_durations(spark, d):
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    starts = stream_of(spark, d, "events").select(F.col("user_id").alias("subject_id"), "event_id", F.col("event_type").alias("stage"), us.alias("us"), F.col("ts").cast("timestamp").alias("ts"))
    out, marks = scratch(spark, "durations"), scratch(spark, "marks")
    rows, last = table(spark, d, "events").agg(F.count(F.lit(1)), F.max(F.col("ts").cast("timestamp"))).first()
    groups = max(64, rows // STAGE_GROUP_ROWS)
    sink = S.live_durations(starts, marks=S.mark_stream(spark, marks), groups=groups).writeStream.format("parquet").option("path", out)
    S.run_to_end(sink, scratch(spark, "progress"), marks, last)
    got = spark.read.schema("subject_id bigint, event_id bigint, stage string, duration_s double, finished boolean").parquet(out)
    return got.filter("finished").select("subject_id", "event_id", "stage", F.round("duration_s", 6).alias("duration_s"))


@query("stream_region_stats", with_(BAG, body=f"""SELECT subject_id, seg, count(*) AS n_voxels, count(*)*({BAG_VOX}) AS volume, round(avg(norm),6) AS v_mean FROM bag WHERE seg<>0 GROUP BY 1,2"""))
def stream_region_stats(spark, d):
    heads = bag_headers(spark, d)
    voxels = stream_of(spark, d, "lineitem").select((F.col("l_suppkey") % 4).alias("subject_id"), (F.col("l_suppkey") % 30).cast("int").alias("seg"), F.col("l_extendedprice").alias("norm"))
    out = scratch(spark, "regions")
    S.run_available(S.live_regions(voxels, out, scratch(spark, "progress")))
    sums = S.stored_regions(spark, out)
    return R.region_stats(sums, heads, exclude=[0], partials=sums).select("subject_id", "seg", "n_voxels", "volume", F.round("v_mean", 6).alias("v_mean"))
