"""Label rewriting, label maps, coordinate changes, header checks and derived measures."""

from pyspark.sql import functions as F

from volspark.functions.matrix import rotation_angles, rotation_from_angles
from volspark.operators import labels as L
from volspark.operators import mapping as M
from volspark.operators import measures as S
from volspark.operators import regions as R
from volspark.queries.fixtures import BAG_VOX, EV, LV, bag_headers, ev, ev_dims, lv, table, with_
from volspark.queries.registry import query


def raw_labels(spark, d):
    """Label-like integers from lineitem: 1000 + part number folded into 0..2999."""
    return table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 4).alias("subject_id"),
        F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey") % 100).otherwise(F.col("l_partkey") % 3000).cast("int").alias("seg"),
    )


RAW = """raw AS (SELECT l_suppkey%4 AS subject_id, CAST(CASE WHEN l_partkey%3=0 THEN l_partkey%100 ELSE l_partkey%3000 END AS INT) AS seg FROM lineitem)"""


def counted(df, *cols):
    return df.groupBy("subject_id", *cols).agg(F.count(F.lit(1)).alias("n"))


def case(changes):
    return "CASE seg " + " ".join(f"WHEN {a} THEN {b}" for a, b in changes.items()) + " ELSE seg END"


@query("reduce_label_ranges", with_(RAW, body="SELECT subject_id, CAST(CASE WHEN seg>=2000 THEN 42 WHEN seg>=1000 THEN 3 ELSE seg END AS INT) AS seg, count(*) AS n FROM raw GROUP BY 1,2"))
def reduce_label_ranges(spark, d):
    return counted(raw_labels(spark, d).withColumn("seg", L.reduce_ranges("seg")), "seg")


@query("clean_cortex_labels", with_(RAW, body=f"SELECT subject_id, CAST({case(L.CORTEX_CLEANING)} AS INT) AS seg, count(*) AS n FROM raw GROUP BY 1,2"))
def clean_cortex_labels(spark, d):
    return counted(raw_labels(spark, d).withColumn("seg", L.clean_cortex("seg")), "seg")


@query("clean_structure_labels", with_(RAW, f"""va AS (SELECT subject_id, CASE WHEN seg BETWEEN 251 AND 999 THEN seg % 251 WHEN seg IN (1000,2000) THEN seg WHEN seg > 2000 THEN 42 WHEN seg > 1000 THEN 3 ELSE seg END AS seg FROM raw)""", body=f"""
SELECT subject_id, CAST({case(L.STRUCTURE_CLEANING)} AS INT) AS seg, count(*) AS n FROM va GROUP BY 1,2"""))
def clean_structure_labels(spark, d):
    # parcels become their side's cortex first, as in the order of processing; ids in between fold into structure ids
    s = F.col("seg")
    valid = F.when(s.between(251, 999), s % 251).when(s.isin(1000, 2000), s).otherwise(L.reduce_ranges("seg"))
    return counted(L.clean_structures(raw_labels(spark, d).withColumn("seg", valid.cast("int"))), "seg")


KEPT = ",".join(map(str, L.KEPT_RIGHT_PARCELS))


@query("fuse_parcels", with_(RAW, body=f"""SELECT subject_id, CAST(CASE WHEN seg IN ({KEPT}) THEN seg WHEN c BETWEEN 2000 AND 2999 THEN c-1000 ELSE c END AS INT) AS fused, count(*) AS n
FROM (SELECT *, {case(L.CORTEX_CLEANING)} AS c FROM raw) GROUP BY 1,2"""))
def fuse_parcels(spark, d):
    rows = raw_labels(spark, d).withColumn("cleaned", L.clean_cortex("seg"))
    return counted(rows.withColumn("fused", L.fuse_parcels("cleaned", "seg")), "fused")


@query("paint_over_labels", with_(EV, LV, body="""
SELECT e.subject_id, e.x, e.y, e.z, coalesce(l.seg, e.blk) AS blk FROM ev e
LEFT JOIN (SELECT * FROM lv WHERE seg BETWEEN 4 AND 6) l USING (subject_id, x, y, z)"""))
def paint_over_labels(spark, d):
    other = lv(spark, d).withColumnRenamed("seg", "blk")
    return L.paint_over(ev(spark, d).select(*L.VOXEL, "blk"), other, "blk", 4, 6)


@query("apply_brain_mask", with_(EV, LV, body="""
SELECT e.subject_id, e.x, e.y, e.z, CAST(CASE WHEN l.n IS NULL THEN 0 ELSE e.blk END AS INT) AS blk FROM ev e LEFT JOIN lv l USING (subject_id, x, y, z)"""))
def apply_brain_mask(spark, d):
    return L.apply_mask(ev(spark, d).select(*L.VOXEL, "blk"), lv(spark, d), "blk")


@query("cerebellum_mask", with_(RAW, body="SELECT subject_id, count(*) FILTER (seg IN (7,46,8,47)) AS n, count(*) FILTER (seg IN (3,5,9)) AS n_lateral FROM raw GROUP BY 1"))
def cerebellum_mask(spark, d):
    return raw_labels(spark, d).groupBy("subject_id").agg(
        F.count_if(R.is_in("seg", L.CEREBELLUM)).alias("n"), F.count_if(L.lateral_mask("seg", [3, 5, 9])).alias("n_lateral")
    )


@query("resolve_label_overlap", with_(EV, body="SELECT subject_id, x, y, z, blk, CAST(CASE WHEN blk<>0 THEN 0 ELSE seg END AS INT) AS seg FROM ev"))
def resolve_label_overlap(spark, d):
    return L.resolve_overlap(ev(spark, d).select(*L.VOXEL, "blk", "seg"), "blk", "seg", True)


@query("crop_box", with_(EV, body="""SELECT subject_id, CAST(x-2 AS INT) AS x, CAST(y+1 AS INT) AS y, CAST(z-10 AS INT) AS z, seg FROM ev
WHERE x BETWEEN 2 AND 5 AND y BETWEEN 0 AND 5 AND z BETWEEN 10 AND 49"""))
def crop_box(spark, d):
    return L.crop(ev(spark, d).select(*L.VOXEL, "seg"), (2, -1, 10), (4, 7, 40))


@query("uncrop_box", with_(EV, body="SELECT subject_id, x+3 AS x, y AS y, z+2 AS z, seg FROM ev WHERE seg > 2"))
def uncrop_box(spark, d):
    return L.uncrop(ev(spark, d).filter("seg > 2").select(*L.VOXEL, "seg"), (3, 0, 2))


@query("crop_centred", with_(EV, body="""SELECT subject_id, CAST(x-2 AS INT) AS x, CAST(y-1 AS INT) AS y, CAST(z-35 AS INT) AS z, seg FROM ev
WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 5 AND z BETWEEN 35 AND 63"""))
def crop_centred(spark, d):
    return L.crop_centred(ev(spark, d).select(*L.VOXEL, "seg"), ev_dims(spark, d), (4, 5, 29))


@query("pad_to_base", with_(EV, body="""SELECT subject_id, CAST(x+4 AS INT) AS x, CAST(y+1 AS INT) AS y, CAST(z-10 AS INT) AS z, seg FROM ev WHERE z BETWEEN 10 AND 90"""))
def pad_to_base(spark, d):
    return L.pad_to_base(ev(spark, d).select(*L.VOXEL, "seg"), ev_dims(spark, d), (16, 11, 81))


@query("pad_edges", with_(EV, """off AS (SELECT unnest(range(0,12)) AS i), offz AS (SELECT unnest(range(0,104)) AS k)""", body="""
SELECT e.subject_id, CAST(a.i AS INT) AS x, CAST(b.i AS INT) AS y, CAST(c.k AS INT) AS z, e.seg FROM ev e
JOIN off a ON least(greatest(a.i-2,0),7)=e.x JOIN off b ON least(greatest(b.i-2,0),7)=e.y JOIN offz c ON least(greatest(c.k-2,0),99)=e.z"""))
def pad_edges(spark, d):
    return L.pad_edges(ev(spark, d).select(*L.VOXEL, "seg"), ev_dims(spark, d), 2)


@query("fit_square", with_(EV, body="SELECT subject_id, x, z, y, seg FROM ev WHERE x < 8 AND z < 32"))
def fit_square(spark, d):
    return L.fit_square(ev(spark, d).select(*L.VOXEL, "seg"), 32, ("x", "z"))


@query("plane_views", with_(EV, body="""SELECT subject_id, 'axial' AS plane, z AS x, x AS y, y AS z, seg FROM ev
UNION ALL SELECT subject_id, 'sagittal', z, y, x, seg FROM ev UNION ALL SELECT subject_id, 'coronal', x, y, z, seg FROM ev"""))
def plane_views(spark, d):
    v = ev(spark, d).select(*L.VOXEL, "seg")
    parts = [L.to_plane(v, p).withColumn("plane", F.lit(p)) for p in ("axial", "sagittal", "coronal")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("flip_axes", with_(EV, body="SELECT subject_id, CAST(7-x AS INT) AS x, y, CAST(99-z AS INT) AS z, seg FROM ev"))
def flip_axes(spark, d):
    return L.flip(ev(spark, d).select(*L.VOXEL, "seg"), ev_dims(spark, d), "xz")


@query("orient_axes", with_(EV, body="""SELECT subject_id, CASE WHEN subject_id%2=0 THEN z ELSE CAST(7-x AS INT) END AS x, y, CASE WHEN subject_id%2=0 THEN CAST(7-x AS INT) ELSE z END AS z, seg FROM ev"""))
def orient_axes(spark, d):
    even = F.col("subject_id") % 2 == 0
    ref = F.expr("array(array(1D,0D,0D,0D),array(0D,1D,0D,0D),array(0D,0D,1D,0D),array(0D,0D,0D,1D))")
    swap = F.expr("array(array(0D,0.1D,1D,0D),array(0D,1D,0D,0D),array(-1D,0D,0.2D,0D),array(0D,0D,0D,1D))")
    mirror = F.expr("array(array(-1D,0.1D,0D,0D),array(0D,1D,0D,0D),array(0D,0D,1D,0D),array(0D,0D,0D,1D))")
    headers = ev_dims(spark, d).select("subject_id", ref.alias("ref_affine"), F.when(even, swap).otherwise(mirror).alias("affine"))
    plan = L.plan_orientation(headers)
    return L.orient_to(ev(spark, d).select(*L.VOXEL, "seg"), plan, ev_dims(spark, d))


@query("affine_coordinates", with_(EV, body="""SELECT subject_id, x, y, z, round((-0.5*x+0.25*z+4)::DOUBLE,6) AS wx, round((1.5*y-subject_id)::DOUBLE,6) AS wy, round((0.1*x+0.2*y+0.3*z)::DOUBLE,6) AS wz FROM ev"""))
def affine_coordinates(spark, d):
    m = F.array(
        F.array(F.lit(-0.5), F.lit(0.0), F.lit(0.25), F.lit(4.0)),
        F.array(F.lit(0.0), F.lit(1.5), F.lit(0.0), -F.col("subject_id").cast("double")),
        F.array(F.lit(0.1), F.lit(0.2), F.lit(0.3), F.lit(0.0)),
    )
    out = L.apply_affine(ev(spark, d).select(*L.VOXEL), ev_dims(spark, d).select("subject_id", m.alias("m")))
    return out.select(*L.VOXEL, *(F.round(c, 6).alias(c) for c in ("wx", "wy", "wz")))


@query("warp_labels", with_(EV, """f AS (SELECT *, CAST(round_even(x+(seg-2)*0.6,0) AS INT) AS tx, CAST(round_even(z+label*0.5,0) AS INT) AS tz FROM ev)""", body="""
SELECT f.subject_id, f.x, f.y, f.z, coalesce(e.blk,0) AS blk FROM f LEFT JOIN ev e ON e.subject_id=f.subject_id AND e.x=f.tx AND e.y=f.y AND e.z=f.tz"""))
def warp_labels(spark, d):
    v = ev(spark, d)
    field = v.select(*L.VOXEL, ((F.col("seg") - 2) * 0.6).alias("dx"), F.lit(0.0).alias("dy"), (F.col("label") * 0.5).alias("dz"))
    return L.warp_labels(field, v, "blk")


# --- headers from supplier ---------------------------------------------------------------------------


def headers(spark, d):
    k = F.col("s_suppkey")
    zoom = F.when(k % 4 == 0, 1.0).otherwise((50 + k % 60) / 100.0)
    affine = F.array(
        F.array(-zoom, F.lit(0.0), F.when(k % 7 == 0, 0.1).otherwise(0.0), F.lit(12.5)),
        F.array(F.lit(0.0), F.lit(0.0), zoom, F.lit(-3.0)),
        F.array(F.lit(0.0), F.when(k % 5 == 0, zoom).otherwise(-zoom), F.lit(0.0), k.cast("double")),
    )
    return table(spark, d, "supplier").select(
        k.alias("subject_id"),
        F.array(F.lit(256), F.when(k % 3 == 0, 200).otherwise(256), (F.lit(250) + k % 8).cast("int")).alias("dims"),
        F.array(zoom, zoom, F.when(k % 6 == 0, zoom + 0.25).otherwise(zoom)).alias("zooms"),
        affine.alias("affine"),
        F.when(k % 9 == 0, "int16").otherwise("uint8").alias("dtype"),
    )


HEAD = """hd0 AS (SELECT s_suppkey AS subject_id, s_suppkey AS k, (CASE WHEN s_suppkey%4=0 THEN 1.0 ELSE (50+s_suppkey%60)/100.0 END)::DOUBLE AS z0,
  CASE WHEN s_suppkey%3=0 THEN 200 ELSE 256 END AS n1, 250+s_suppkey%8 AS n2, s_suppkey%9<>0 AS ok_dtype FROM supplier),
hd AS (SELECT *, CASE WHEN k%6=0 THEN z0+0.25::DOUBLE ELSE z0 END AS z2 FROM hd0)"""


@query("scale_factors", with_(HEAD, body="""
SELECT subject_id, 'sagittal' AS plane, round(1/z2,6) AS factor_0, round(1/z0,6) AS factor_1 FROM hd
UNION ALL SELECT subject_id, 'axial', round(1/z0,6), round(1/z2,6) FROM hd UNION ALL SELECT subject_id, 'coronal', round(1/z0,6), round(1/z0,6) FROM hd"""))
def scale_factors(spark, d):
    out = L.scale_factors(headers(spark, d))
    return out.select("subject_id", "plane", F.round("factor_0", 6).alias("factor_0"), F.round("factor_1", 6).alias("factor_1"))


@query("conform_target_size", with_(HEAD, """m AS (SELECT *, least(round_even(least(z0,z2)*10000,0)/10000, 1.0::DOUBLE) AS s FROM hd),
t AS (SELECT *, CASE WHEN s > 0.95 THEN 1.0::DOUBLE ELSE s END AS v FROM m)""", body="""
SELECT subject_id, round(v,6) AS vox_size, CAST(CASE WHEN v=1 THEN 256 ELSE greatest(256, ceil(floor(greatest(256*z0, n1*z0, n2*z2)/v*10000)/10000)) END AS INT) AS cube FROM t"""))
def conform_target_size(spark, d):
    size, cube = L.target_size("min", 0.95)
    return headers(spark, d).select("subject_id", F.round(size, 6).alias("vox_size"), cube.alias("cube"))


@query("conformity_checks", with_(HEAD, body="""
SELECT *, ok_dims AND ok_size AND ok_zoom AND ok_orientation AND ok_dtype AS conform FROM (
SELECT subject_id, true AS ok_dims, n1=256 AND n2=256 AS ok_size, z0=1 AND z2=1 AS ok_zoom, k%5<>0 AND k%7<>0 AS ok_orientation, ok_dtype FROM hd)"""))
def conformity_checks(spark, d):
    return L.conformity(headers(spark, d))


@query("header_geometry_equal", with_(HEAD, body="""
SELECT subject_id, k%3<>1 OR n1=200 AS same_dims, k%11<>0 AS same_affine, k%6<>0 OR abs(z2-z0)<=0.05*z2 AS same_zoom FROM hd"""))
def header_geometry_equal(spark, d):
    a = headers(spark, d)
    k = F.col("subject_id")
    b = a.withColumn("dims", F.when(k % 3 == 1, F.array(F.lit(256), F.lit(200), F.col("dims")[2])).otherwise(F.col("dims")))
    moved = F.transform("affine", lambda r: F.transform(r, lambda v: v + F.when(k % 11 == 0, 0.01).otherwise(1e-9)))
    b = b.withColumn("affine", moved).withColumn("zooms_b", F.array(*(F.col("zooms")[0] for _ in range(3))))
    zoom = b.select("subject_id", L.same_zoom("zooms", "zooms_b").alias("same_zoom"))
    return L.same_geometry(a, b).join(zoom, "subject_id")


@query("header_affine_consistent", with_(HEAD, body="""
SELECT subject_id, k%6<>0 AND NOT (k%7=0 AND abs(sqrt(0.01+z0*z0)-z0)>1e-3) AS consistent, round(CASE WHEN k%2=0 THEN -z0-0.5 ELSE -z0 END,6) AS a00 FROM hd"""))
def header_affine_consistent(spark, d):
    h = headers(spark, d)
    k = F.col("subject_id")
    shift = F.when(k % 2 == 0, -0.5).otherwise(1e-5)
    s = F.when(k % 3 == 0, F.lit(None)).otherwise(F.transform("affine", lambda r: F.transform(r, lambda v: v + shift)))
    s = F.when(k % 2 == 0, F.transform("affine", lambda r: F.transform(r, lambda v: v - 0.5))).otherwise(s)
    both = h.withColumn("qform", F.col("affine")).withColumn("sform", s)
    return both.select("subject_id", L.header_consistent().alias("consistent"), F.round(L.effective_affine()[0][0], 6).alias("a00"))


@query("modality_mode", """SELECT l_suppkey AS subject_id, CASE WHEN a AND b THEN 't1t2' WHEN a THEN 't1' WHEN b THEN 't2' END AS mode FROM (
SELECT l_suppkey, bool_or(l_returnflag='A') a, bool_or(l_returnflag='R' AND l_suppkey%2=0) b FROM lineitem GROUP BY 1)""")
def modality_mode(spark, d):
    rows = table(spark, d, "lineitem")
    m = F.when(F.col("l_returnflag") == "A", "t1").when((F.col("l_returnflag") == "R") & (F.col("l_suppkey") % 2 == 0), "t2")
    return L.modality_mode(rows.select(F.col("l_suppkey").alias("subject_id"), F.coalesce(m, F.lit("-")).alias("modality")))


@query("rotation_angles", """SELECT c_custkey AS id, ((c_custkey%170)-85)::DOUBLE AS alpha, ((c_custkey%120)-60)::DOUBLE AS beta, (((c_custkey%300)-150)*0.5)::DOUBLE AS gamma FROM customer""")
def rotation_angles_query(spark, d):
    k = F.col("c_custkey")
    m = rotation_from_angles((k % 170) - 85.0, (k % 120) - 60.0, ((k % 300) - 150) * 0.5)
    rows = table(spark, d, "customer").select(k.alias("id"), m.alias("m"))
    names = ("alpha", "beta", "gamma")
    return rows.select("id", *(F.round(a, 6).alias(n) for n, a in zip(names, rotation_angles("m"), strict=True)))


# --- label maps --------------------------------------------------------------------------------------


def part_map(spark, d, low=10):
    return table(spark, d, "part").filter(F.col("p_size") > low).select(
        F.col("p_partkey").cast("int").alias("src"), F.col("p_size").cast("int").alias("dst")
    )


def part_labels(spark, d):
    top = F.lit(part_map(spark, d).agg(F.max("src")).first()[0])
    return table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 4).alias("subject_id"), F.least(F.col("l_partkey").cast("int"), top).alias("seg")
    )


@query("label_map_left_zero", """WITH m AS (SELECT p_partkey AS src, p_size AS dst FROM part WHERE p_size > 10)
SELECT l_suppkey%4 AS subject_id, CAST(coalesce(dst,0) AS INT) AS seg, count(*) AS n FROM lineitem
LEFT JOIN m ON src = least(l_partkey, (SELECT max(src) FROM m)) GROUP BY 1,2""")
def label_map_left_zero(spark, d):
    return counted(M.map_labels(part_labels(spark, d), part_map(spark, d)), "seg")


@query("name_map_strict", """SELECT l_suppkey%4 AS subject_id, p_brand AS brand, count(*) AS n FROM lineitem JOIN part ON p_partkey=l_partkey GROUP BY 1,2""")
def name_map_strict(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    rows = rows.select((F.col("l_suppkey") % 4).alias("subject_id"), F.col("l_partkey").cast("string").alias("name"))
    m = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("src"), F.col("p_brand").alias("dst"))
    return counted(M.map_labels(rows, m, "name", "brand", strict=True), "brand")


@query("reverse_label_map", "SELECT p_size AS src, CAST(max(p_partkey) AS INT) AS dst FROM part GROUP BY 1")
def reverse_label_map(spark, d):
    return M.reverse_map(part_map(spark, d, -1))


@query("map_bijective", "SELECT 'size' AS map_name, count(*) = count(DISTINCT p_size) AS bijective FROM part UNION ALL SELECT 'key', count(*) = count(DISTINCT p_partkey) FROM part")
def map_bijective(spark, d):
    p = table(spark, d, "part")
    maps = {"size": part_map(spark, d, -1), "key": p.select(F.col("p_size").alias("src"), F.col("p_partkey").alias("dst"))}
    parts = [M.bijective(m).select(F.lit(n).alias("map_name"), "bijective") for n, m in maps.items()]
    return parts[0].unionByName(parts[1])


@query("chain_label_maps", "SELECT CAST(p_partkey AS INT) AS src, CAST(p_size*7 AS INT) AS dst FROM part")
def chain_label_maps(spark, d):
    first = part_map(spark, d, -1)
    second = first.select(F.col("dst").alias("src")).distinct().select("src", (F.col("src") * 7).cast("int").alias("dst"))
    return M.chain_maps(first, second)


@query("merge_label_maps", """SELECT CAST(coalesce(a.p_partkey, b.ps) AS INT) AS src, coalesce(b.d, a.p_size) AS dst FROM part a
FULL JOIN (SELECT p_partkey*2 AS ps, -p_size AS d FROM part) b ON a.p_partkey=b.ps""")
def merge_label_maps(spark, d):
    a = part_map(spark, d, -1)
    b = a.select((F.col("src") * 2).alias("src"), (-F.col("dst")).alias("dst"))
    return M.merge_maps(a, b)


@query("class_map_compressed", """WITH m AS (SELECT p_partkey AS src, p_size*3 AS dst FROM part WHERE p_partkey NOT IN (1,2,5) UNION ALL SELECT unnest([1,2,5]), unnest([1,2,5]))
SELECT CAST(src AS INT) AS src, CAST(dense_rank() OVER (ORDER BY dst) - 1 AS INT) AS dst FROM m""")
def class_map_compressed(spark, d):
    m = part_map(spark, d, -1).select("src", (F.col("dst") * 3).alias("dst"))
    return M.class_map(m, keep=[1, 2, 5], compress=True)


@query("label_positions", """SELECT CAST(row_number() OVER (ORDER BY p_partkey*2) - 1 AS INT) AS src, CAST(p_partkey*2 AS INT) AS dst FROM part""")
def label_positions(spark, d):
    return M.position_map(table(spark, d, "part").select((F.col("p_partkey") * 2).alias("id")))


def part_lut(spark, d):
    k = F.col("p_partkey")
    prefix = F.when(k % 3 == 0, "Left-").when(k % 3 == 1, "Right-").otherwise("ctx-")
    return table(spark, d, "part").select(
        k.cast("int").alias("id"), F.concat(prefix, F.lit("area"), F.floor(k / 3).cast("string")).alias("label_name"),
        (k % 256).cast("int").alias("r"), (k % 7).cast("int").alias("g"), (k % 99).cast("int").alias("b"),
    )


PLUT = """plut AS (SELECT CAST(p_partkey AS INT) AS id, (CASE p_partkey%3 WHEN 0 THEN 'Left-' WHEN 1 THEN 'Right-' ELSE 'ctx-' END)||'area'||(p_partkey//3) AS label_name FROM part)"""


@query("lateral_pairs", with_(PLUT, body="""SELECT a.id AS src, b.id AS dst FROM plut a JOIN plut b ON a.label_name LIKE 'Left-%' AND b.label_name LIKE 'Right-%'
AND replace(a.label_name,'Left-','')=replace(b.label_name,'Right-','')"""))
def lateral_pairs(spark, d):
    return M.pair_sides(part_lut(spark, d))


@query("labels_without_prefix", with_(PLUT, body="SELECT id, label_name FROM plut WHERE NOT (label_name LIKE 'Left-%' OR label_name LIKE 'ctx-%')"))
def labels_without_prefix(spark, d):
    return M.without_prefixes(part_lut(spark, d), ["Left-", "ctx-"]).select("id", "label_name")


@query("full_to_sagittal", with_(RAW, body="""
SELECT subject_id, seg, CAST(f AS INT) AS position, count(*) AS n FROM (
 SELECT *, CASE WHEN c < 100 AND c%2=0 THEN c+1 ELSE c END AS f FROM (SELECT *, CASE WHEN seg BETWEEN 2000 AND 2999 THEN seg-1000 ELSE seg END AS c FROM raw)) GROUP BY 1,2,3"""))
def full_to_sagittal(spark, d):
    ids = raw_labels(spark, d).select("seg").distinct()
    sides = ids.filter("seg < 100 AND seg % 2 = 0").select(F.col("seg").alias("src"), (F.col("seg") + 1).alias("dst"))
    listed = spark.range(0, 3000).select(F.col("id").cast("int").alias("id"))
    return counted(M.full_to_sagittal(raw_labels(spark, d), sides, M.position_map(listed)), "seg", "position")


@query("gather_sagittal_scores", f"""WITH idx AS (SELECT unnest(range(1,{len(M.gather_index(51)) + 1})) AS i, unnest({M.gather_index(51)}) AS j)
SELECT vec_id, CAST(i-1 AS INT) AS c, embedding[j+1]::DOUBLE AS s FROM embeddings, idx""")
def gather_sagittal_scores(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", M.gather_scores("embedding", M.gather_index(51)).alias("g"))
    return rows.select("vec_id", F.posexplode("g").alias("c", "s")).withColumn("s", F.col("s").cast("double"))


@query("infer_sagittal_index", """WITH l AS (SELECT p_partkey AS pos, p_partkey % 2500 AS id FROM part), s AS (SELECT c_custkey * 3 % 1000 AS k, max(c_custkey) AS pos FROM customer GROUP BY 1),
r AS (SELECT s_suppkey * 7 AS src, max(s_suppkey * 3 % 1000) AS dst FROM supplier GROUP BY 1)
SELECT l.pos, l.id, coalesce(a.pos, b.pos, c.pos) AS index FROM l LEFT JOIN s a ON a.k = id LEFT JOIN s b ON b.k = id - 1000 LEFT JOIN r ON src = id LEFT JOIN s c ON c.k = dst""")
def infer_sagittal_index(spark, d):
    labels = table(spark, d, "part").select(F.col("p_partkey").alias("pos"), (F.col("p_partkey") % 2500).alias("id"))
    k = F.col("c_custkey")
    sagittal = table(spark, d, "customer").groupBy((k * 3 % 1000).alias("id")).agg(F.max(k).alias("pos"))
    s = F.col("s_suppkey")
    remap = table(spark, d, "supplier").groupBy((s * 7).alias("src")).agg(F.max(s * 3 % 1000).alias("dst"))
    return M.infer_index(labels, sagittal, remap)


def long_scores(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("c", "e"))
    return rows.select("vec_id", "c", (F.col("e").cast("double") + 1).alias("s"))


SPREAD = "ls AS (SELECT vec_id, unnest(range(0,64)) AS c, unnest(embedding)::DOUBLE+1 AS s FROM embeddings)"


@query("map_scores_prob", with_(SPREAD, body="""SELECT vec_id, CAST(t AS INT) AS c, round(sum(s),6) AS s FROM (SELECT *, c//8*2 AS t FROM ls) GROUP BY 1,2
UNION ALL SELECT vec_id, CAST(unnest([1,3,5,7,9,11,13]) AS INT), 0.0 FROM embeddings"""))
def map_scores_prob(spark, d):
    m = long_scores(spark, d).select(F.col("c").alias("src")).distinct().select("src", (F.floor(F.col("src") / 8) * 2).cast("int").alias("dst"))
    return M.map_scores(long_scores(spark, d), m, ["vec_id"]).withColumn("s", F.round("s", 6))


@query("map_scores_logit", with_(SPREAD, body="SELECT vec_id, CAST(c//8 AS INT) AS c, round(product(s),6) AS s FROM ls GROUP BY 1,2"))
def map_scores_logit(spark, d):
    m = long_scores(spark, d).select(F.col("c").alias("src")).distinct().select("src", F.floor(F.col("src") / 8).cast("int").alias("dst"))
    return M.map_scores(long_scores(spark, d), m, ["vec_id"], mode="logit").withColumn("s", F.round("s", 6))


@query("map_scores_reverse", with_(SPREAD, body="SELECT vec_id, CAST(u*8+k AS INT) AS c, round(s/8,6) AS s FROM (SELECT vec_id, c AS u, s, unnest(range(0,8)) AS k FROM ls WHERE c < 8)"))
def map_scores_reverse(spark, d):
    m = long_scores(spark, d).select(F.col("c").alias("src")).distinct().select("src", F.floor(F.col("src") / 8).cast("int").alias("dst"))
    return M.map_scores(long_scores(spark, d), m, ["vec_id"], reverse=True).withColumn("s", F.round("s", 6))


@query("map_by_name", with_(PLUT, body="SELECT id AS src, CAST(id+100000 AS INT) AS dst FROM plut"))
def map_by_name(spark, d):
    a = part_lut(spark, d)
    return M.join_by_name(a, a.withColumn("id", F.col("id") + 100000))


@query("map_same_names", with_(PLUT, body="SELECT id AS src, id*2 AS dst FROM plut"))
def map_same_names(spark, d):
    a = part_lut(spark, d).withColumn("pos", F.col("id"))
    return M.same_names(a, a.withColumn("id", F.col("id") * 2))


@query("structure_names", with_(LV, body="""SELECT subject_id, seg, n, CASE WHEN r_name IS NOT NULL THEN r_name WHEN seg=6 THEN 'Merged-Label-6' ELSE 'Unknown-Label' END AS struct_name
FROM (SELECT subject_id, seg, count(*) AS n FROM lv GROUP BY 1,2) LEFT JOIN region ON r_regionkey=seg"""))
def structure_names(spark, d):
    lut = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("label_name"))
    return R.with_names(counted(lv(spark, d), "seg"), lut, [6])


@query("colour_index", with_(PLUT, body="""SELECT id, CAST(dense_rank() OVER (ORDER BY id)-1 AS INT) AS color_index, round((id%256)/255.0,6) AS r, round((id%7)/255.0,6) AS g, round((id%99)/255.0,6) AS b
FROM plut WHERE id IN (SELECT l_partkey FROM lineitem)"""))
def colour_index(spark, d):
    present = table(spark, d, "lineitem").select(F.col("l_partkey").cast("int").alias("seg"))
    out = M.colour_index(present, part_lut(spark, d))
    return out.select("id", "color_index", *(F.round(c, 6).alias(c) for c in "rgb"))


@query("stack_colour_tables", """SELECT c_nationkey AS table_id, pos, c_custkey AS id, nm||'.'||c_nationkey AS label_name FROM (
 SELECT *, CAST(c_custkey//25 AS BIGINT) AS pos, CASE WHEN c_custkey < 50 AND c_custkey%2=0 THEN 'unknown' ELSE c_mktsegment END AS nm FROM customer) WHERE NOT (pos=0 AND nm='unknown')""")
def stack_colour_tables(spark, d):
    k = F.col("c_custkey")
    t = table(spark, d, "customer").select(
        F.col("c_nationkey").alias("table_id"), F.floor(k / 25).alias("pos"), k.alias("id"),
        F.when((k < 50) & (k % 2 == 0), "unknown").otherwise(F.col("c_mktsegment")).alias("label_name"),
    )
    return M.stack_tables(t, F.concat(F.lit("."), F.col("table_id").cast("string")))


# --- measures ----------------------------------------------------------------------------------------


def label_bag(spark, d):
    """Voxels whose labels fall on the ids that the measures use."""
    s = F.col("l_suppkey")
    seg = F.when(s % 5 == 0, 250 + s % 7).when(s % 5 == 1, 600 + s % 35).when(s % 5 == 2, 1000 + s % 40).otherwise(s % 86)
    return table(spark, d, "lineitem").select(
        (s % 4).alias("subject_id"), seg.cast("int").alias("seg"), F.col("l_extendedprice").alias("norm")
    )


LBAG = """lbag AS (SELECT l_suppkey%4 AS subject_id, CASE l_suppkey%5 WHEN 0 THEN 250+l_suppkey%7 WHEN 1 THEN 600+l_suppkey%35 WHEN 2 THEN 1000+l_suppkey%40 ELSE l_suppkey%86 END AS seg FROM lineitem)"""
CLASS_KEYS = [m.key for m in S.CATALOGUE.values() if m.kind == "classes"]


def class_sql(key):
    ids = ",".join(map(str, S.CATALOGUE[key].classes))
    return f"SELECT subject_id, '{key}' AS key, count(*) FILTER (seg IN ({ids}))*({BAG_VOX}) AS value FROM lbag GROUP BY 1"


CLASSES = "cm AS (" + " UNION ALL ".join(class_sql(k) for k in CLASS_KEYS) + ")"


@query("class_measures", with_(LBAG, CLASSES, body="SELECT * FROM cm"))
def class_measures(spark, d):
    partials = R.with_volume(R.region_partials(label_bag(spark, d)), bag_headers(spark, d))
    return S.class_measures(partials)


WIDE = "w AS (SELECT subject_id, " + ", ".join(f"any_value(value) FILTER (key='{k}') AS \"{k}\"" for k in CLASS_KEYS) + " FROM cm GROUP BY 1)"
DERIVED_SQL = {
    "Cerebellum": '"CerebellarGM"+"CerebellarWM"',
    "BrainSegNotVent": '"BrainSeg"-"VentricleChoroidVol"-"TFFC"',
    "SupraTentorial": '"BrainSeg"-"CerebellarGM"-"CerebellarWM"',
    "SupraTentorialNotVent": '"BrainSeg"-"CerebellarGM"-"CerebellarWM"-"VentricleChoroidVol"-"TFFC"',
    "SupraTentorialNotVentVox": f'("BrainSeg"-"CerebellarGM"-"CerebellarWM"-"VentricleChoroidVol"-"TFFC")/({BAG_VOX})',
    "TotalGray": "NULL",
}


@query("derived_measures", with_(LBAG, CLASSES, WIDE, body=" UNION ALL ".join(
    f"SELECT subject_id, '{k}' AS key, round(({e})::DOUBLE,6) AS value, '{S.unit_of(k)}' AS unit FROM w" for k, e in DERIVED_SQL.items())))
def derived_measures(spark, d):
    values = class_measures(spark, d)
    out = S.derived_measures(values, list(DERIVED_SQL), bag_headers(spark, d))
    return out.select("subject_id", "key", F.round("value", 6).alias("value"), "unit")


@query("measure_ratio_etiv", with_(LBAG, CLASSES, body="""
SELECT subject_id, 'BrainSegVol-to-eTIV' AS key, round(value/(1948106.0/((1+subject_id)*1.25)),9) AS value FROM cm WHERE key='BrainSeg'"""))
def measure_ratio_etiv(spark, d):
    s = F.col("subject_id").cast("double")
    m = F.array(
        F.array(F.lit(1.0) + s, F.lit(0.5), F.lit(0.0), F.lit(9.0)),
        F.array(F.lit(0.0), F.lit(1.0), F.lit(0.5), F.lit(1.0)),
        F.array(F.lit(0.0), F.lit(-0.5), F.lit(1.0), F.lit(2.0)),
    )
    etiv = bag_headers(spark, d).withColumn("m", m).select(
        "subject_id", F.lit("EstimatedTotalIntraCranialVol").alias("key"), S.intracranial_volume("m").alias("value")
    )
    values = class_measures(spark, d).unionByName(etiv)
    out = S.derived_measures(values, ["BrainSegVol-to-eTIV"], bag_headers(spark, d))
    return out.select("subject_id", "key", F.round("value", 9).alias("value"))


@query("import_measures", with_(LBAG, CLASSES, body="""
SELECT subject_id, key, value FROM cm UNION ALL SELECT subject_id, 'Extra', 7.0 FROM (SELECT DISTINCT subject_id FROM cm)"""))
def import_measures(spark, d):
    own = class_measures(spark, d)
    other = own.filter(F.col("key") == "TFFC").withColumn("value", F.lit(-1.0))
    extra = other.withColumn("key", F.lit("Extra")).withColumn("value", F.lit(7.0))
    return S.import_measures(own, other.unionByName(extra))


@query("sided_label_volumes", with_(EV, "off AS (SELECT dx, dy, dz FROM (SELECT unnest(range(-3,4)) dx), (SELECT unnest(range(-3,4)) dy), (SELECT unnest(range(-3,4)) dz))",
    "v AS (SELECT subject_id, x, y, z, CASE blk WHEN 1 THEN 2 WHEN 2 THEN 77 WHEN 3 THEN 10 ELSE 50 END AS l FROM ev)",
    "t AS (SELECT a.subject_id, a.x AS x0, a.y AS y0, a.z AS z0, " + ", ".join(
        f"CASE WHEN a.{a}+o.d{a}<0 THEN -1-(a.{a}+o.d{a}) WHEN a.{a}+o.d{a}>={n} THEN {2 * n}-1-(a.{a}+o.d{a}) ELSE a.{a}+o.d{a} END AS {a}" for a, n in (("x", 8), ("y", 8), ("z", 100)))
    + " FROM v a, off o WHERE a.l=77)",
    "f AS (SELECT subject_id, x0, y0, z0, count(*) FILTER (v.l IN (2,10))/343.0::DOUBLE AS f FROM t JOIN v USING (subject_id, x, y, z) GROUP BY 1,2,3,4)", body="""
SELECT subject_id, 'lhWM-hypointensities' AS key, count(*) FILTER (f>0.2)*0.5::DOUBLE AS value FROM f GROUP BY 1 UNION ALL SELECT subject_id, 'rhWM-hypointensities', count(*) FILTER (NOT f>0.2)*0.5::DOUBLE FROM f GROUP BY 1"""))
def sided_label_volumes(spark, d):
    b = F.col("blk")
    label = F.when(b == 1, 2).when(b == 2, 77).when(b == 3, 10).otherwise(50)
    heads = ev_dims(spark, d).select("subject_id", F.lit(0.5).alias("vox_vol"))
    return S.sided_measures(ev(spark, d).withColumn("seg", label), ev_dims(spark, d), heads)


# --- the whole catalogue from labels, meshes, masks and transforms --------------------------------------

SURFACES = ("orig.nofix", "pial", "white")
CATALOGUE_SEG = "CASE blk WHEN 1 THEN 2 WHEN 2 THEN 77 WHEN 3 THEN 10 WHEN 4 THEN 251 ELSE CASE seg % 4 WHEN 0 THEN 14 WHEN 1 THEN 4 WHEN 2 THEN 46 ELSE 41 END END"


def catalogue_meshes(spark, d):
    """Six 10 x 10 grid meshes per 100 embeddings: two sides, three surfaces; some faces of the right side are missing."""
    kinds = F.array(*(F.struct(F.lit(h).alias("hemi"), F.lit(s).alias("surface"), F.lit(9 * i + 3 * j).alias("o")) for i, h in enumerate(("lh", "rh")) for j, s in enumerate(SURFACES)))
    rows = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("subject_id"), (F.col("vec_id") % 100).alias("vid"), "embedding", F.explode(kinds).alias("m"))
    keys = ("subject_id", "m.hemi", "m.surface")
    vertices = rows.select(*keys, "vid", *(F.element_at("embedding", F.col("m.o") + k).cast("double").alias(a) for k, a in ((1, "x"), (2, "y"), (3, "z"))))
    v = F.col("vid")
    tri = F.array(
        F.struct((2 * v).alias("fid"), v.alias("v0"), (v + 1).alias("v1"), (v + 10).alias("v2")), F.struct((2 * v + 1).alias("fid"), (v + 1).alias("v0"), (v + 11).alias("v1"), (v + 10).alias("v2"))
    )
    faces = rows.filter((v < 90) & (v % 10 < 9)).select(*keys, F.explode(tri).alias("t")).select("subject_id", "hemi", "surface", "t.*")
    return faces.filter((F.col("hemi") == "lh") | (F.col("fid") % 5 != 0)), vertices


CATALOGUE_MESH = """md AS (SELECT hemi, surface, 9*i+3*j AS o FROM (VALUES ('lh',0),('rh',1)) h(hemi,i), (VALUES ('orig.nofix',0),('pial',1),('white',2)) s(surface,j)),
mv AS MATERIALIZED (SELECT vec_id//100 AS subject_id, vec_id%100 AS vid, hemi, surface, embedding[o+1]::DOUBLE AS x, embedding[o+2]::DOUBLE AS y, embedding[o+3]::DOUBLE AS z FROM embeddings, md),
f0 AS (SELECT subject_id, hemi, surface, vid, 2*vid AS fid, vid AS v0, vid+1 AS v1, vid+10 AS v2 FROM mv UNION ALL SELECT subject_id, hemi, surface, vid, 2*vid+1, vid+1, vid+11, vid+10 FROM mv),
mf AS MATERIALIZED (SELECT * FROM f0 WHERE vid < 90 AND vid%10 < 9 AND (hemi='lh' OR fid%5 <> 0)),
de AS (SELECT subject_id, hemi, v0 AS a, v1 AS b FROM mf WHERE surface='orig.nofix' UNION ALL SELECT subject_id, hemi, v1, v2 FROM mf WHERE surface='orig.nofix' UNION ALL SELECT subject_id, hemi, v2, v0 FROM mf WHERE surface='orig.nofix'),
mh AS (SELECT subject_id, hemi||'SurfaceHoles' AS key, trunc(1-(v-e+f)/2)::DOUBLE AS value FROM (SELECT subject_id, hemi, count(DISTINCT (least(a,b), greatest(a,b))) AS e, count(*)//3 AS f FROM de GROUP BY 1,2)
 JOIN (SELECT subject_id, hemi, count(DISTINCT u) AS v FROM (SELECT subject_id, hemi, unnest([a,b]) AS u FROM de) GROUP BY 1,2) USING (subject_id, hemi)),
mo AS (SELECT f.subject_id, f.hemi||CASE f.surface WHEN 'pial' THEN 'PialTotal' ELSE 'WhiteMatterTotal' END AS key,
 sum(a.x*(b.y*c.z-b.z*c.y)-a.y*(b.x*c.z-b.z*c.x)+a.z*(b.x*c.y-b.y*c.x))/6.0 AS value FROM mf f
 JOIN mv a ON a.subject_id=f.subject_id AND a.hemi=f.hemi AND a.surface=f.surface AND a.vid=f.v0 JOIN mv b ON b.subject_id=f.subject_id AND b.hemi=f.hemi AND b.surface=f.surface AND b.vid=f.v1
 JOIN mv c ON c.subject_id=f.subject_id AND c.hemi=f.hemi AND c.surface=f.surface AND c.vid=f.v2 WHERE f.surface <> 'orig.nofix' GROUP BY ALL)"""
CATALOGUE_LEAVES = ", ".join([
    f"sg AS MATERIALIZED (SELECT subject_id, x, y, z, {CATALOGUE_SEG} AS l FROM ev)",
    "o7 AS (SELECT dx, dy, dz FROM (SELECT unnest(range(-3,4)) dx), (SELECT unnest(range(-3,4)) dy), (SELECT unnest(range(-3,4)) dz))",
    "t7 AS (SELECT a.subject_id, a.x AS x0, a.y AS y0, a.z AS z0, " + ", ".join(
        f"CASE WHEN a.{a}+o.d{a}<0 THEN -1-(a.{a}+o.d{a}) WHEN a.{a}+o.d{a}>={n} THEN {2 * n}-1-(a.{a}+o.d{a}) ELSE a.{a}+o.d{a} END AS {a}" for a, n in (("x", 8), ("y", 8), ("z", 100))) + " FROM sg a, o7 o WHERE a.l=77)",
    "f7 AS (SELECT subject_id, x0, y0, z0, count(*) FILTER (l IN (2,4,5,7,8,10,11,12,13,17,18,26,28,30,31))/343.0::DOUBLE AS f FROM t7 JOIN sg USING (subject_id, x, y, z) GROUP BY 1,2,3,4)",
    "lf AS (" + " UNION ALL ".join(f"SELECT subject_id, '{k}' AS key, count(*) FILTER (l IN ({','.join(map(str, S.CATALOGUE[k].classes))}))*0.5::DOUBLE AS value FROM sg GROUP BY 1" for k in CLASS_KEYS)
    + " UNION ALL SELECT subject_id, 'lhWM-hypointensities', count(*) FILTER (f>0.2)*0.5::DOUBLE FROM f7 GROUP BY 1 UNION ALL SELECT subject_id, 'rhWM-hypointensities', count(*) FILTER (NOT f>0.2)*0.5::DOUBLE FROM f7 GROUP BY 1"
    + " UNION ALL FROM mh UNION ALL FROM mo UNION ALL SELECT subject_id, 'Mask', count(*) FILTER (seg>0)*0.5::DOUBLE FROM ev GROUP BY 1"
    + " UNION ALL SELECT DISTINCT subject_id, 'EstimatedTotalIntraCranialVol', 1948106.0/((1+subject_id)*1.25)::DOUBLE FROM ev)",
])
LEAF_KEYS = [*CLASS_KEYS, *(f"{h}{k}" for h in ("lh", "rh") for k in ("WM-hypointensities", "SurfaceHoles", "PialTotal", "WhiteMatterTotal")), "Mask", "EstimatedTotalIntraCranialVol"]
_NOT_VENT = '"BrainSeg"-"VentricleChoroidVol"-"TFFC"'
_SUPRA = '"BrainSeg"-"CerebellarGM"-"CerebellarWM"'
CATALOGUE_SQL = {k: f'"{k}"' for k in LEAF_KEYS} | {
    "SurfaceHoles": '"rhSurfaceHoles"+"lhSurfaceHoles"',
    "lhCortex": '"lhPialTotal"-"lhWhiteMatterTotal"',
    "rhCortex": '"rhPialTotal"-"rhWhiteMatterTotal"',
    "Cortex": '"lhPialTotal"-"lhWhiteMatterTotal"+"rhPialTotal"-"rhWhiteMatterTotal"',
    "lhCerebralWhiteMatter": '"lhWhiteMatterVol"+"lhWM-hypointensities"+0.5*"CorpusCallosumVol"',
    "rhCerebralWhiteMatter": '"rhWhiteMatterVol"+"rhWM-hypointensities"+0.5*"CorpusCallosumVol"',
    "CerebralWhiteMatter": '"lhWhiteMatterVol"+"lhWM-hypointensities"+"rhWhiteMatterVol"+"rhWM-hypointensities"+"CorpusCallosumVol"',
    "TotalGray": '"SubCortGray"+"lhPialTotal"-"lhWhiteMatterTotal"+"rhPialTotal"-"rhWhiteMatterTotal"+"CerebellarGM"',
    "BrainSegNotVent": _NOT_VENT,
    "BrainSegNotVentSurf": _NOT_VENT,
    "Cerebellum": '"CerebellarGM"+"CerebellarWM"',
    "SupraTentorial": _SUPRA,
    "SupraTentorialNotVent": _SUPRA + '-"VentricleChoroidVol"-"TFFC"',
    "SupraTentorialNotVentVox": f'({_SUPRA}-"VentricleChoroidVol"-"TFFC")/0.5',
    "BrainSegVol-to-eTIV": '"BrainSeg"/"EstimatedTotalIntraCranialVol"',
    "MaskVol-to-eTIV": '"Mask"/"EstimatedTotalIntraCranialVol"',
}
_UNITLESS = ("SurfaceHoles", "lhSurfaceHoles", "rhSurfaceHoles", "SupraTentorialNotVentVox", "BrainSegVol-to-eTIV", "MaskVol-to-eTIV")


@query("catalogue_measures", with_(EV, CATALOGUE_MESH, CATALOGUE_LEAVES, "w AS MATERIALIZED (SELECT subject_id, " + ", ".join(f"any_value(value) FILTER (key='{k}') AS \"{k}\"" for k in LEAF_KEYS) + " FROM lf GROUP BY 1)",
    body=" UNION ALL ".join(f"SELECT subject_id, '{k}' AS key, round(({e})::DOUBLE,6) AS value, {str(k.endswith('SurfaceHoles')).lower()} AS is_int, '{'unitless' if k in _UNITLESS else 'mm^3'}' AS unit FROM w" for k, e in CATALOGUE_SQL.items())))
def catalogue_measures(spark, d):
    heads = ev_dims(spark, d).select("subject_id", F.lit(0.5).alias("vox_vol"))
    voxels = ev(spark, d)
    s = F.col("subject_id").cast("double")
    matrix = F.array(
        F.array(F.lit(1.0) + s, F.lit(0.5), F.lit(0.0), F.lit(9.0)), F.array(F.lit(0.0), F.lit(1.0), F.lit(0.5), F.lit(1.0)), F.array(F.lit(0.0), F.lit(-0.5), F.lit(1.0), F.lit(2.0))
    )
    faces, vertices = catalogue_meshes(spark, d)
    out = S.catalogue_measures(
        voxels.select(*L.VOXEL, F.expr(CATALOGUE_SEG).alias("seg")), ev_dims(spark, d), heads, faces, vertices,
        voxels.select(*L.VOXEL, F.col("seg").alias("value")), heads.select("subject_id", matrix.alias("matrix")),
    )
    return out.select("subject_id", "key", F.round("value", 6).alias("value"), "is_int", "unit")


@query("cerebellum_groups", """SELECT CAST(CASE WHEN c_name LIKE '%1%' THEN 8 WHEN c_name LIKE '%2%' THEN 47 ELSE 632 END AS INT) AS group_id, c_custkey AS member_id FROM customer
WHERE (c_name LIKE '%1%' OR c_name LIKE '%2%' OR c_name LIKE '%3%') AND c_custkey%10<>0""")
def cerebellum_groups(spark, d):
    c = table(spark, d, "customer")
    side = F.when(F.contains("c_name", F.lit("1")), "Left").when(F.contains("c_name", F.lit("2")), "Right").when(F.contains("c_name", F.lit("3")), "Vermis").otherwise("-")
    name = F.concat(side, F.when(F.col("c_custkey") % 10 == 0, "_Medullare").otherwise("_Cortex"))
    return R.cerebellum_groups(c.select(F.col("c_custkey").alias("id"), name.alias("label_name")))


@query("sorted_region_table", with_(LV, body="SELECT subject_id, seg, count(*) AS n FROM lv GROUP BY 1,2"))
def sorted_region_table(spark, d):
    return R.sorted_table(counted(lv(spark, d), "seg"))


@query("member_mask", with_(LV, body="SELECT subject_id, x, y, z, seg FROM lv WHERE seg IN (SELECT r_regionkey FROM region)"))
def member_mask(spark, d):
    groups = table(spark, d, "region").select(F.lit(1).alias("group_id"), F.col("r_regionkey").alias("member_id"))
    return R.member_mask(lv(spark, d).select(*L.VOXEL, "seg"), groups)
