"""Agreement of label volumes, score fusion, components and nearest neighbours."""

from pyspark.sql import functions as F

from volspark.operators import agreement as A
from volspark.operators import components as C
from volspark.operators import fusion as V
from volspark.operators.labels import VOXEL
from volspark.operators.nearest import nearest_points
from volspark.queries.fixtures import EV, LV, MESH, SCORES, ev, ev_dims, lv, mesh_vertices, scores, table, with_
from volspark.queries.grid_ops import ball, cube, eroded, moved
from volspark.queries.region_tables import rounded
from volspark.queries.registry import query

CC = """cc AS (SELECT subject_id, cls, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(t) AS BIGINT) AS n_truth, CAST(sum(p) AS BIGINT) AS n_pred FROM (
 SELECT subject_id, seg AS cls, (seg=pred)::INT tp, 1 t, 0 p FROM lv UNION ALL SELECT subject_id, pred, 0, 0, 1 FROM lv) GROUP BY 1,2)"""


def lv_classes(spark, d):
    return A.class_counts(A.confusion(lv(spark, d)))


@query("confusion_counts", with_(LV, body="SELECT subject_id, seg AS truth, pred, count(*) AS n FROM lv GROUP BY 1,2,3"))
def confusion_counts(spark, d):
    return A.confusion(lv(spark, d))


@query("class_counts", with_(LV, CC, body="SELECT * FROM cc"))
def class_counts(spark, d):
    return lv_classes(spark, d)


@query("agreement_scores", with_(LV, CC, body="""SELECT subject_id, cls, n_truth+n_pred-tp AS "union", round(2*tp/(n_truth+n_pred),6) AS dice,
 round(1-2*tp/(n_truth+n_pred),6) AS dissimilarity, round(tp/(n_truth+n_pred-tp),6) AS iou, round(tp/nullif(n_truth,0),6) AS recall,
 round(tp/nullif(n_pred,0),6) AS "precision", round(1-abs(n_pred-n_truth)/(n_pred+n_truth),6) AS volume_similarity FROM cc"""))
def agreement_scores(spark, d):
    out = A.scores(lv_classes(spark, d)).drop("tp", "n_truth", "n_pred")
    return rounded(out, "dice", "dissimilarity", "iou", "recall", "precision", "volume_similarity")


@query("mean_dice", with_(LV, CC, body="SELECT subject_id, round(avg(2*tp/(n_truth+n_pred)),6) AS mean_dice FROM cc WHERE cls IN (1,2,3,7) GROUP BY 1"))
def mean_dice(spark, d):
    per_class = A.class_counts(A.confusion(lv(spark, d)), classes=[1, 2, 3, 7])
    return rounded(A.mean_dice(per_class), "mean_dice")


@query("dice_matrix", with_(LV, """t AS (SELECT subject_id, seg AS truth, count(*) nt FROM lv GROUP BY 1,2), p AS (SELECT subject_id, pred, count(*) np FROM lv GROUP BY 1,2),
c AS (SELECT subject_id, seg AS truth, pred, count(*) n FROM lv GROUP BY 1,2,3)""", body="""
SELECT subject_id, truth, pred, round(2*coalesce(n,0)/(nt+np),6) AS dice FROM t JOIN p USING (subject_id) LEFT JOIN c USING (subject_id, truth, pred)"""))
def dice_matrix(spark, d):
    return rounded(A.dice_matrix(A.confusion(lv(spark, d))), "dice")


def class_groups(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("g"))
    first = r.select((F.col("g") + 100).alias("group_id"), (F.col("g") + 1).alias("member_id"))
    second = r.select((F.col("g") + 100).alias("group_id"), (F.col("g") + 3).alias("member_id"))
    return first.unionAll(second)


@query("merged_class_scores", with_(LV, "g AS (SELECT r_regionkey+100 AS grp, [r_regionkey+1, r_regionkey+3] AS m FROM region)", body="""
SELECT subject_id, CAST(grp AS INT) AS cls, count(*) FILTER (list_contains(m, seg)) AS n_truth, count(*) FILTER (list_contains(m, pred)) AS n_pred,
 round(2*count(*) FILTER (list_contains(m, seg) AND list_contains(m, pred))/(count(*) FILTER (list_contains(m, seg))+count(*) FILTER (list_contains(m, pred))),6) AS dice
FROM lv, g GROUP BY 1,2"""))
def merged_class_scores(spark, d):
    out = A.scores(A.merged_counts(A.confusion(lv(spark, d)), class_groups(spark, d)))
    return rounded(out, "dice").select("subject_id", "cls", "n_truth", "n_pred", "dice")


@query("wide_score_row", with_(LV, CC, body="SELECT subject_id, " + ", ".join(
    f"round(any_value(2*tp/(n_truth+n_pred)) FILTER (cls={i}),6) AS \"{n}\"" for i, n in enumerate(["AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"], 1))
    + ", round(avg(2*tp/(n_truth+n_pred)) FILTER (cls BETWEEN 1 AND 4),6) AS mean FROM cc GROUP BY 1"))
def wide_score_row(spark, d):
    names = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("label_name"))
    order = ["AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    return rounded(A.wide_scores(lv_classes(spark, d), names, order), *order, "mean")


@query("group_mean_scores", with_(LV, """
gc AS (SELECT g, cls, sum(tp) tp, sum(t) t, sum(p) p FROM (SELECT z%3 AS g, seg AS cls, (seg=pred)::INT tp, 1 t, 0 p FROM lv UNION ALL SELECT z%3, pred, 0, 0, 1 FROM lv) WHERE cls<>1 GROUP BY 1,2)""", body="""
SELECT g AS scale_group, round(avg(tp/(t+p-tp)),6) AS mean_iou, round(avg(CASE WHEN t>0 THEN tp/t END),6) AS mean_recall, round(avg(CASE WHEN p>0 THEN tp/p END),6) AS mean_precision,
 (SELECT round(avg(s),6) FROM (SELECT sum(tp/(t+p-tp)) s FROM gc GROUP BY cls)) AS score FROM gc GROUP BY 1"""))
def group_mean_scores(spark, d):
    rows = lv(spark, d).select((F.col("z") % 3).alias("scale_group"), (F.col("seg") - 1).alias("seg"), (F.col("pred") - 1).alias("pred"))
    per_class = A.class_counts(A.confusion(rows, by=["scale_group"]), ["scale_group"])
    score = A.final_score(per_class, "scale_group").select("score").scalar()
    out = A.group_scores(per_class, "scale_group").withColumn("score", score)
    return rounded(out, "mean_iou", "mean_recall", "mean_precision", "score")


@query("mean_squared_error", with_(LV, body="SELECT subject_id, round(avg((seg-pred)*(seg-pred)),6) AS mse FROM lv GROUP BY 1"))
def mean_squared_error(spark, d):
    return rounded(A.mean_squared_error(lv(spark, d), "seg", "pred"), "mse")


SURF = ", ".join(
    f"m{n} AS (SELECT subject_id*10+{n} AS subject_id, x, y, z FROM ev WHERE hole={n}), p{n} AS (SELECT subject_id*10+{n} AS subject_id, x, y, z FROM ev WHERE blk={n})" for n in (1, 2, 3, 4)
) + ", mt AS (" + " UNION ALL ".join(f"FROM m{n}" for n in (1, 2, 3, 4)) + "), mp AS (" + " UNION ALL ".join(f"FROM p{n}" for n in (1, 2, 3, 4)) + ")"


@query("hausdorff_distances", with_(EV, cube(1), SURF, f"st AS (FROM mt EXCEPT ({eroded('mt', 1, 7)}))", f"sp AS (FROM mp EXCEPT ({eroded('mp', 1, 7)}))", """
dd AS (SELECT a.subject_id, min((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)*4) AS d FROM st a LEFT JOIN sp b USING (subject_id) GROUP BY a.subject_id, a.x, a.y, a.z
 UNION ALL SELECT a.subject_id, min((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)*4) FROM sp a LEFT JOIN st b USING (subject_id) GROUP BY a.subject_id, a.x, a.y, a.z)""", body="""
SELECT subject_id//10 AS subject_id, CAST(subject_id%10 AS INT) AS cls, round(max(sqrt(d)),6) AS hd, round(quantile_cont(sqrt(d),0.5),6) AS hd50, round(quantile_cont(sqrt(d),0.95),6) AS hd95 FROM dd GROUP BY 1,2"""))
def hausdorff_distances(spark, d):
    return rounded(A.hausdorff(ev(spark, d), ev_dims(spark, d), "hole", "blk", (1.0, 1.0, 2.0)), "hd", "hd50", "hd95")


LOSS = """l0 AS (SELECT vec_id, label%4 AS t, i//4 AS q, i%4 AS c, s FROM (SELECT vec_id, label, unnest(range(0,64)) AS i, unnest(embedding)::DOUBLE AS s FROM embeddings)),
l1 AS (SELECT *, exp(s)/sum(exp(s)) OVER (PARTITION BY vec_id, q) AS p, vec_id//100 AS subject_id, 1+vec_id%3 AS w FROM l0),
l2 AS (SELECT subject_id, c, 1-2*sum(p*(c=t)::INT)/(sum(p+(c=t)::INT)+0.001) AS dl FROM l1 GROUP BY 1,2),
l3 AS (SELECT subject_id, avg(-ln(p)*w) AS ce FROM l1 WHERE c=t GROUP BY 1)"""


@query("score_losses", with_(LOSS, body="SELECT subject_id, round(avg(dl),6) AS dice_loss, round(any_value(ce),6) AS ce_loss, round(avg(dl)+any_value(ce),6) AS loss FROM l2 JOIN l3 USING (subject_id) GROUP BY 1"))
def score_losses(spark, d):
    e = table(spark, d, "embeddings")
    fours = F.explode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda q: F.transform(F.slice("embedding", q * 4 + 1, 4), lambda v: v.cast("double"))))
    rows = e.select(
        F.floor(F.col("vec_id") / 100).alias("subject_id"), (F.col("label") % 4).alias("label"), fours.alias("s"), (1 + F.col("vec_id") % 3).alias("weight"),
    )
    return rounded(A.evaluate_losses(rows), "dice_loss", "ce_loss", "loss")


# --- fusion ------------------------------------------------------------------------------------------

FUSED = "fu AS (SELECT voxel, c, sum(s*CASE plane WHEN 2 THEN 0.2::DOUBLE ELSE 0.4::DOUBLE END) AS score FROM scores GROUP BY 1,2)"
WEIGHTS = {0: 0.4, 1: 0.4, 2: 0.2}


@query("view_aggregation", with_(SCORES, FUSED, body="SELECT voxel, c, round(score,6) AS score FROM fu"))
def view_aggregation(spark, d):
    return rounded(V.fuse_scores(scores(spark, d), WEIGHTS), "score")


@query("view_aggregation_argmax", with_(SCORES, "f2 AS (SELECT voxel, c, sum(s*CASE plane WHEN 2 THEN 1 ELSE 2 END) AS score FROM scores GROUP BY 1,2)", body="""
SELECT voxel, CAST(c AS INT) AS label, score FROM f2 QUALIFY row_number() OVER (PARTITION BY voxel ORDER BY score DESC, c)=1"""))
def view_aggregation_argmax(spark, d):
    fused = V.fuse_arrays(scores(spark, d), {0: 2.0, 1: 2.0, 2: 1.0}, 4)
    return fused.select("voxel", V.argmax("s").alias("label"), F.array_max("s").alias("score"))


@query("view_aggregation_long", with_(SCORES, "f2 AS (SELECT voxel, c, sum(s*CASE plane WHEN 2 THEN 1 ELSE 2 END) AS score FROM scores GROUP BY 1,2)", body="""
SELECT voxel, CAST(c AS INT) AS label, score FROM f2 QUALIFY row_number() OVER (PARTITION BY voxel ORDER BY score DESC, c)=1"""))
def view_aggregation_long(spark, d):
    return V.hard_labels(V.fuse_scores(scores(spark, d), {0: 2.0, 1: 2.0, 2: 1.0}))


@query("argmax_array", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding))-1 AS INT) AS label FROM embeddings")
def argmax_array(spark, d):
    return table(spark, d, "embeddings").select("vec_id", V.argmax("embedding").alias("label"))


@query("clip_to_extent", with_(EV, body="SELECT subject_id, x, y, z, seg FROM ev WHERE x<6 AND z<90"))
def clip_to_extent(spark, d):
    return V.clip_to_extent(ev(spark, d).select(*VOXEL, "seg"), {"x": 6, "z": 90})


# --- components --------------------------------------------------------------------------------------


def reach(src, limit, out="comp"):
    """Component ids by reachability from smaller ids; ``src`` has subject_id, g, x, y, z."""
    return (
        f"nd AS MATERIALIZED (SELECT subject_id, g, x, y, z, (x::BIGINT<<40)+(y::BIGINT<<20)+z AS id FROM {src})",
        f"""ed AS MATERIALIZED (SELECT s.subject_id, s.g, s.id0 AS a, n.id AS b FROM {moved('nd', ball(limit), 'a.g, a.id AS id0,')} s JOIN nd n USING (subject_id, g, x, y, z) WHERE s.id0<>n.id)""",
        """rc AS (SELECT subject_id, g, id, id AS c FROM nd UNION SELECT rc.subject_id, rc.g, ed.b, rc.c FROM rc JOIN ed ON ed.subject_id=rc.subject_id AND ed.g=rc.g AND ed.a=rc.id WHERE rc.c < ed.b)""",
        f"{out} AS (SELECT nd.subject_id, nd.g, x, y, z, m.c AS component FROM nd JOIN (SELECT subject_id, g, id, min(c) AS c FROM rc GROUP BY 1,2,3) m USING (subject_id, g, id))",
    )


HOLES = "hs AS (SELECT subject_id, hole AS g, x, y, z FROM ev WHERE hole<>0)"


@query("components_6", with_(EV, cube(1), HOLES, *reach("hs", 1), body="SELECT subject_id, g AS hole, x, y, z, component FROM comp", recursive=True))
def components_6(spark, d):
    return C.voxel_components(ev(spark, d).filter("hole <> 0"), 6, ["hole"])


@query("components_26", with_(EV, cube(1), HOLES, *reach("hs", 3), body="SELECT subject_id, g AS hole, x, y, z, component FROM comp", recursive=True))
def components_26(spark, d):
    return C.voxel_components(ev(spark, d).filter("hole <> 0"), 26, ["hole"])


@query("components_18_sizes", with_(EV, cube(1), "hs AS (SELECT subject_id, 0 AS g, x, y, z FROM ev WHERE seg>=4)", *reach("hs", 2), body="SELECT subject_id, component, count(*) AS n_voxels FROM comp GROUP BY 1,2", recursive=True))
def components_18_sizes(spark, d):
    return C.component_sizes(C.voxel_components(ev(spark, d).filter("seg >= 4"), 18))


BEST = "bs AS (SELECT subject_id, g, component FROM comp GROUP BY 1,2,3 QUALIFY row_number() OVER (PARTITION BY subject_id, g ORDER BY count(*) DESC, component)=1)"


@query("largest_component", with_(EV, cube(1), "hs AS (SELECT subject_id, 0 AS g, x, y, z FROM ev WHERE seg>=4)", *reach("hs", 3), BEST, body="SELECT subject_id, x, y, z FROM comp JOIN bs USING (subject_id, g, component)", recursive=True))
def largest_component(spark, d):
    return C.keep_largest(ev(spark, d).filter("seg >= 4").select(*VOXEL))


@query("non_largest_per_class", with_(EV, cube(1), HOLES, *reach("hs", 3), BEST, body="SELECT subject_id, g AS hole, x, y, z, bs.component IS NOT NULL AS largest FROM comp LEFT JOIN bs USING (subject_id, g, component)", recursive=True))
def non_largest_per_class(spark, d):
    return C.split_largest(ev(spark, d).filter("hole <> 0"), 26, ["hole"]).drop("component")


@query("drop_small_components", with_(EV, cube(1), "hs AS (SELECT subject_id, 0 AS g, x, y, z FROM ev WHERE seg>=4)", *reach("hs", 3), body="SELECT subject_id, x, y, z FROM comp QUALIFY count(*) OVER (PARTITION BY subject_id, component) > 3", recursive=True))
def drop_small_components(spark, d):
    return C.drop_small(ev(spark, d).filter("seg >= 4").select(*VOXEL), 3)


# --- nearest neighbours ------------------------------------------------------------------------------


@query("nearest_vertex", with_(MESH, body="""SELECT q.subject_id, q.vid AS qid, round(min(sqrt((q.x-t.x)**2+(q.y-t.y)**2+(q.z-t.z)**2)),6) AS distance,
 arg_min(t.vid, (q.x-t.x)**2+(q.y-t.y)**2+(q.z-t.z)**2) AS tid FROM mv q JOIN mv t ON t.subject_id=q.subject_id AND q.vid>=250 AND t.vid<250 GROUP BY 1,2"""))
def nearest_vertex(spark, d):
    v = mesh_vertices(spark, d)
    q = v.filter("vid >= 250").withColumnRenamed("vid", "qid")
    t = v.filter("vid < 250").withColumnRenamed("vid", "tid")
    return rounded(nearest_points(q, t), "distance")


@query("nearest_cell_distance", with_(LV, body="""SELECT q.subject_id, q.x, q.y, q.z, round(sqrt(min((q.x-t.x)**2+(q.y-t.y)**2+(q.z-t.z)**2)),6) AS distance
FROM lv q JOIN (SELECT * FROM lv WHERE seg=1) t ON t.subject_id=q.subject_id AND q.seg>=7 GROUP BY 1,2,3,4"""))
def nearest_cell_distance(spark, d):
    v = lv(spark, d).withColumn("id", F.col("x") * 10000 + F.col("y") * 100 + F.col("z"))
    q = v.filter("seg >= 7").withColumnRenamed("id", "qid")
    t = v.filter("seg = 1").withColumnRenamed("id", "tid")
    out = nearest_points(q, t)
    x, rest = F.floor(F.col("qid") / 10000), F.col("qid") % 10000
    cells = [x.cast("int").alias("x"), F.floor(rest / 100).cast("int").alias("y"), (rest % 100).cast("int").alias("z")]
    return out.select("subject_id", *cells, F.round("distance", 6).alias("distance"))
