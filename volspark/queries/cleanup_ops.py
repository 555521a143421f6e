"""Partial volume, and clean-up of segmentations."""

from pyspark.sql import functions as F

from volspark.operators import cleanup as K
from volspark.operators import partial_volume as P
from volspark.operators import regions as R
from volspark.operators.labels import VOXEL
from volspark.queries.agreement_ops import BEST, reach
from volspark.queries.fixtures import EV, ev, ev_dims, with_
from volspark.queries.grid_ops import cube, dilated, eroded, moved, steps
from volspark.queries.region_tables import rounded
from volspark.queries.registry import query


def headers(spark, d):
    return ev_dims(spark, d).select("subject_id", F.lit(0.5).alias("vox_vol"))


def pv_voxels(spark, d):
    return ev(spark, d).select(*VOXEL, F.col("blk").alias("seg"), F.floor((F.col("norm") + F.col("blk")) * 1000).cast("double").alias("norm"))


PV = (
    cube(1),
    "pv AS MATERIALIZED (SELECT subject_id, x, y, z, blk AS seg, floor((norm+blk)*1000) AS v FROM ev)",
    f"wn AS MATERIALIZED (SELECT s.subject_id, s.x0 AS x, s.y0 AS y, s.z0 AS z, s.own, s.v, s.l1, b.seg AS c FROM {moved('pv', '(SELECT *, abs(dx)+abs(dy)+abs(dz) AS l1 FROM off)', 'a.seg AS own, a.v AS v, o.l1,')} s JOIN pv b USING (subject_id, x, y, z))",
    "bd AS MATERIALIZED (SELECT subject_id, x, y, z FROM wn WHERE l1 <= 1 GROUP BY 1,2,3,4 HAVING min(c) <> max(c))",
    "cd AS MATERIALIZED (SELECT subject_id, x, y, z, any_value(own) AS own, any_value(v) AS v, c, bool_or(l1=1) AS face FROM wn SEMI JOIN bd USING (subject_id, x, y, z) GROUP BY subject_id, x, y, z, c)",
    "r15 AS (SELECT unnest(range(-7,8)) AS k)",
    "s1 AS MATERIALIZED (SELECT subject_id, seg, x+k AS x, y, z, count(*) AS n, sum(v) AS t FROM pv, r15 WHERE x+k BETWEEN 0 AND 7 GROUP BY 1,2,3,4,5)",
    "s2 AS MATERIALIZED (SELECT subject_id, seg, x, y+k AS y, z, sum(n) AS n, sum(t) AS t FROM s1, r15 WHERE y+k BETWEEN 0 AND 7 GROUP BY 1,2,3,4,5)",
    "s3 AS MATERIALIZED (SELECT subject_id, seg AS c, x, y, z+k AS z, sum(n) AS n, sum(t) AS t FROM s2, r15 GROUP BY 1,2,3,4,5)",
    "mn AS MATERIALIZED (SELECT subject_id, x, y, z, own, v, c, face, round((t/n)::DOUBLE,10) AS m, round((n/3375)::DOUBLE,6) AS f FROM cd JOIN s3 USING (subject_id, x, y, z, c))",
    "ow AS MATERIALIZED (SELECT subject_id, x, y, z, m AS om FROM mn WHERE c=own)",
    "vl AS MATERIALIZED (SELECT mn.*, om FROM mn JOIN ow USING (subject_id, x, y, z) WHERE c<>own AND (m>v)<>(om>v) AND m<>v AND abs(om-v)>1e-6 QUALIFY row_number() OVER (PARTITION BY subject_id, x, y, z ORDER BY f DESC, c)=1)",
    """pm AS MATERIALIZED (SELECT b.subject_id, b.x, b.y, b.z, b.own AS seg, CAST(coalesce(vl.c,0) AS INT) AS nbr, om AS seg_mean, coalesce(vl.m,0) AS nbr_mean, vl.face,
 CASE WHEN vl.c IS NULL OR abs(om-vl.m)<=1e-6 THEN 1.0::DOUBLE ELSE least(greatest((b.v-vl.m)/(om-vl.m),0),1) END AS mix
 FROM (SELECT subject_id, x, y, z, own, v, om FROM mn JOIN ow USING (subject_id, x, y, z) WHERE c=own) b LEFT JOIN (SELECT * EXCLUDE (om, v, own) FROM vl) vl USING (subject_id, x, y, z))""",
)
VOLUMES = """SELECT subject_id, seg, round((n+coalesce(a,0))*0.5,6) AS volume FROM (SELECT subject_id, seg, count(*) n FROM pv GROUP BY 1,2) LEFT JOIN
 (SELECT subject_id, seg, sum(a) a FROM (SELECT subject_id, seg, mix-1 AS a FROM pm UNION ALL SELECT subject_id, nbr, {rest} FROM pm) GROUP BY 1,2) USING (subject_id, seg)"""


@query("partial_volume_maps", with_(EV, *PV, body="SELECT subject_id, x, y, z, seg, nbr, round(seg_mean,6) AS seg_mean, round(nbr_mean,6) AS nbr_mean, round(mix,6) AS mix, round(1-mix,6) AS nbr_mix FROM pm"))
def partial_volume_maps(spark, d):
    out = P.partial_volume_maps(pv_voxels(spark, d), ev_dims(spark, d))
    return rounded(out, "seg_mean", "nbr_mean", "mix", "nbr_mix")


@query("partial_volume_volumes", with_(EV, *PV, body=VOLUMES.format(rest="1-mix")))
def partial_volume_volumes(spark, d):
    return rounded(P.partial_volume_volumes(pv_voxels(spark, d), ev_dims(spark, d), headers(spark, d)), "volume")


@query("partial_volume_legacy", with_(EV, *PV, body=VOLUMES.format(rest="CASE WHEN face THEN 1-mix ELSE 0 END")))
def partial_volume_legacy(spark, d):
    return rounded(P.partial_volume_volumes(pv_voxels(spark, d), ev_dims(spark, d), headers(spark, d), legacy=True), "volume")


@query("region_stats_partial_volume", with_(EV, *PV, "vo AS (" + VOLUMES.format(rest="1-mix") + ")", body="""
SELECT subject_id, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY seg) AS INT) AS row_index, seg, n_voxels, volume, round(m,6) AS v_mean
FROM (SELECT subject_id, seg, count(*) AS n_voxels, avg(v) AS m FROM pv WHERE seg<>0 GROUP BY 1,2) JOIN vo USING (subject_id, seg)"""))
def region_stats_partial_volume(spark, d):
    v = pv_voxels(spark, d)
    volumes = P.partial_volume_volumes(v, ev_dims(spark, d), headers(spark, d))
    out = R.region_stats(v, headers(spark, d), exclude=[0], volumes=volumes)
    return rounded(out, "volume", "v_mean").select("subject_id", "row_index", "seg", "n_voxels", "volume", "v_mean")


BODY = ("b0 AS (SELECT subject_id, x, y, z FROM ev WHERE seg>=4 AND blk<>4)", *(f"b{k} AS MATERIALIZED ({dilated(f'b{k - 1}', 3)})" for k in range(1, 6)),
        *(f"b{k} AS MATERIALIZED ({eroded(f'b{k - 1}', 3, 27)})" for k in range(6, 10)), "hs AS (SELECT subject_id, 0 AS g, x, y, z FROM b9)")


@query("brain_mask", with_(EV, cube(1), *BODY, *reach("hs", 3), BEST, body="""
SELECT subject_id, x, y, z FROM comp JOIN bs USING (subject_id, g, component) UNION SELECT subject_id, x, y, z FROM ev WHERE seg>=4 AND blk=4""", recursive=True))
def brain_mask(spark, d):
    v = ev(spark, d).withColumn("l", F.when(F.col("seg") < 4, 0).when(F.col("blk") == 4, 1012).otherwise(5))
    return K.brain_mask(v, ev_dims(spark, d), 5, 4, "l")


BLURRED = """(SELECT t.subject_id, t.x0 AS x, t.y0 AS y, t.z0 AS z, {agg} FROM (SELECT e.subject_id, e.x AS x0, e.y AS y0, e.z AS z0, o.w, {match} FROM ev e, {kernel} o) t JOIN ev s USING (subject_id, x, y, z) GROUP BY 1,2,3,4)"""


def near(a, n):
    return f"greatest(0, least({n - 1}, e.{a}+o.d{a})) AS {a}"


NEAR = ", ".join(near(a, n) for a, n in (("x", 8), ("y", 8), ("z", 100)))


def kernel(name, sigma):
    r = int(4 * sigma + 0.5)
    one = f"(SELECT unnest(range({-r},{r + 1})) i)"
    return f"{name}1 AS (SELECT i, exp(-0.5*(i/{sigma})*(i/{sigma}))/(SELECT sum(exp(-0.5*(i/{sigma})*(i/{sigma}))) FROM {one}) AS w FROM {one}), {name} AS MATERIALIZED (SELECT a.i AS dx, b.i AS dy, c.i AS dz, a.w*b.w*c.w AS w FROM {name}1 a, {name}1 b, {name}1 c)"


@query("flip_islands", with_(EV, cube(1), kernel("gk", 1.5), "hs AS (SELECT subject_id, hole AS g, x, y, z FROM ev WHERE hole IN (1,3))", *reach("hs", 3), BEST,
    "fd AS " + BLURRED.format(agg="round(sum(t.w*CASE WHEN s.hole IN (1,2) THEN -1 WHEN s.hole IN (3,4) THEN 1 ELSE 0 END),9) AS f", match=NEAR, kernel="gk"), body="""
SELECT ev.subject_id, ev.x, ev.y, ev.z, CAST(CASE WHEN c.component IS NOT NULL AND bs.component IS NULL AND hole=3 AND f<0 THEN 1 WHEN c.component IS NOT NULL AND bs.component IS NULL AND hole=1 AND f>0 THEN 3 ELSE hole END AS INT) AS hole
FROM ev JOIN fd USING (subject_id, x, y, z) LEFT JOIN comp c USING (subject_id, x, y, z) LEFT JOIN bs ON bs.subject_id=c.subject_id AND bs.g=c.g AND bs.component=c.component""", recursive=True))
def flip_islands(spark, d):
    return K.flip_islands(ev(spark, d).select(*VOXEL, "hole"), ev_dims(spark, d), "hole", ((1, 2), (3, 4)), 1.5)


@query("clean_regions")
def clean_regions(spark, d):
    v = ev(spark, d).withColumn("l", F.when(F.col("seg") >= 4, F.col("blk") + F.col("label")).otherwise(0))
    return K.clean_regions(v.select(*VOXEL, "l"), ev_dims(spark, d), "l")


def mirrored(a, n, sigma=5.0):
    """Rows (i, j, w): the weight with which position j of an axis of n enters the blur at i, edges mirrored again and again."""
    r = int(4 * sigma + 0.5)
    return f"""g{a} AS MATERIALIZED (SELECT i, CASE WHEN p < {n} THEN p ELSE {2 * n - 1} - p END AS j, sum(exp(-0.5*(k/{sigma})*(k/{sigma})) / s) AS w
 FROM (SELECT i, k, s, ((i + k) % {2 * n} + {2 * n}) % {2 * n} AS p FROM range({n}) r(i), range({-r}, {r + 1}) q(k), (SELECT sum(exp(-0.5*(k/{sigma})*(k/{sigma}))) AS s FROM range({-r}, {r + 1}) q(k))) GROUP BY ALL)"""


def along(name, src, a, value):
    """One axis of the blur of every label."""
    return f"{name} AS MATERIALIZED (SELECT subject_id, l, {', '.join('i AS ' + b if b == a else b for b in 'xyz')}, sum({value}*w) AS v FROM {src} JOIN g{a} ON {a} = j GROUP BY ALL)"


@query("fill_unknown_by_blur", with_(EV, cube(1), *(mirrored(a, n) for a, n in (("x", 8), ("y", 8), ("z", 100))), "u AS (SELECT *, CASE WHEN seg>=4 THEN 1 ELSE blk+1 END AS l FROM ev)",
    f"tc AS MATERIALIZED (SELECT DISTINCT b.subject_id, b.l FROM {moved('(SELECT * FROM u WHERE l=1)', steps(2))} s JOIN u b USING (subject_id, x, y, z) WHERE b.l>1 AND b.l<5)",
    "rv AS (SELECT u.subject_id, u.x, u.y, u.z, u.l FROM u SEMI JOIN tc ON tc.subject_id=u.subject_id AND tc.l=u.l)", along("bx", "rv", "x", "1"), along("bxy", "bx", "y", "v"), along("bxyz", "bxy", "z", "v"),
    "bf AS (SELECT * FROM (SELECT subject_id, x, y, z, l, round(v,12) AS v FROM bxyz) QUALIFY row_number() OVER (PARTITION BY subject_id, x, y, z ORDER BY v DESC, l)=1)", body="""
SELECT u.subject_id, u.x, u.y, u.z, CAST(CASE WHEN u.l=1 THEN coalesce(bf.l, f.l, u.l) ELSE u.l END AS INT) AS l FROM u LEFT JOIN bf USING (subject_id, x, y, z) LEFT JOIN (SELECT subject_id, min(l) AS l FROM tc GROUP BY 1) f ON f.subject_id=u.subject_id"""))
def fill_unknown_by_blur(spark, d):
    v = ev(spark, d).withColumn("l", F.when(F.col("seg") >= 4, 1).otherwise(F.col("blk") + 1))
    return K.fill_by_blur(v.select(*VOXEL, "l"), ev_dims(spark, d), 1, 5, label="l")


@query("fill_unknown_by_distance", with_(EV, """ds AS (SELECT q.subject_id, q.x, q.y, q.z, s.blk AS l, floor(sqrt(min((q.x-s.x)**2+(q.y-s.y)**2+(q.z-s.z)**2))) AS dist
FROM (SELECT * FROM ev WHERE seg>=5) q JOIN (SELECT * FROM ev WHERE seg<5 AND blk IN (1,2,4)) s USING (subject_id) GROUP BY ALL),
b AS (SELECT * FROM ds QUALIFY row_number() OVER (PARTITION BY subject_id, x, y, z ORDER BY dist, list_position([4,1,2], l))=1)""", body="""
SELECT e.subject_id, e.x, e.y, e.z, CAST(CASE WHEN seg>=5 THEN b.l ELSE e.blk END AS INT) AS blk FROM ev e LEFT JOIN b USING (subject_id, x, y, z)"""))
def fill_unknown_by_distance(spark, d):
    v = ev(spark, d).withColumn("blk", F.when(F.col("seg") >= 5, 0).otherwise(F.col("blk")))
    return K.fill_by_distance(v.select(*VOXEL, "blk"), v.filter("seg >= 5").select(*VOXEL), [4, 1, 2], "blk")


@query("split_parcels")
def split_parcels(spark, d):
    v = ev(spark, d).withColumn("l", F.when(F.col("blk") == 1, 2).when(F.col("blk") == 2, 41).when(F.col("hole") == 3, 1011).when(F.col("hole") == 4, 1003).otherwise(0))
    return K.split_parcels(v.select(*VOXEL, "l"), ev_dims(spark, d), "l")


@query("merge_cerebellum")
def merge_cerebellum(spark, d):
    whole = F.when(F.col("blk") == 1, 7).when(F.col("blk") == 2, 46).when(F.col("blk") == 3, 8).otherwise(0)
    part = F.when(F.col("blk") == 3, F.col("seg") + F.when(F.col("label") > 3, 28).otherwise(5)).otherwise(0)
    v = ev(spark, d).select(*VOXEL, part.cast("int").alias("part"), whole.alias("seg"))
    return K.merge_cerebellum(v, ev_dims(spark, d))
