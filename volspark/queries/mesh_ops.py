"""Mesh counts, rings, voting, islands, sampling, label transfer and alignment."""

from pyspark.sql import functions as F

from volspark.operators import align as N
from volspark.operators import mesh as H
from volspark.queries.fixtures import EV, MESH, ev, ev_dims, mesh_faces, mesh_vertices, with_
from volspark.queries.region_tables import rounded
from volspark.queries.registry import query

DE = "de AS (SELECT subject_id, v0 AS src, v1 AS dst FROM mf UNION ALL SELECT subject_id, v1, v2 FROM mf UNION ALL SELECT subject_id, v2, v0 FROM mf)"
BE = "be AS (FROM de UNION ALL SELECT subject_id, dst, src FROM de)"
RING = "rg AS (SELECT DISTINCT subject_id, src, dst FROM be UNION SELECT DISTINCT subject_id, src, src FROM be)"


@query("euler_numbers", with_(MESH, DE, body="""SELECT subject_id, v-e+f AS euler, CAST(trunc(1-(v-e+f)/2) AS INT) AS holes FROM
 (SELECT subject_id, count(DISTINCT src) v, count(DISTINCT (least(src,dst), greatest(src,dst))) e FROM de GROUP BY 1) JOIN (SELECT subject_id, count(*) f FROM mf GROUP BY 1) USING (subject_id)"""))
def euler_numbers(spark, d):
    return H.euler_numbers(mesh_faces(spark, d))


FV = "fv AS (SELECT f.subject_id, a.vid v0, b.vid v1, c.vid v2, a.x x0, a.y y0, a.z z0, b.x x1, b.y y1, b.z z1, c.x x2, c.y y2, c.z z2 FROM mf f JOIN mv a ON a.subject_id=f.subject_id AND a.vid=v0 JOIN mv b ON b.subject_id=f.subject_id AND b.vid=v1 JOIN mv c ON c.subject_id=f.subject_id AND c.vid=v2)"


@query("mesh_volume", with_(MESH, FV, body="SELECT subject_id, round(sum(x0*(y1*z2-z1*y2)-y0*(x1*z2-z1*x2)+z0*(x1*y2-y1*x2))/6.0,6) AS volume FROM fv GROUP BY 1"))
def mesh_volume(spark, d):
    return rounded(H.enclosed_volume(mesh_faces(spark, d), mesh_vertices(spark, d)), "volume")


NV = """cr AS (SELECT *, (y1-y0)*(z2-z0)-(z1-z0)*(y2-y0) AS nx, (z1-z0)*(x2-x0)-(x1-x0)*(z2-z0) AS ny, (x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) AS nz FROM fv),
ns AS (SELECT subject_id, vid, sum(nx) nx, sum(ny) ny, sum(nz) nz FROM (SELECT subject_id, unnest([v0,v1,v2]) AS vid, nx, ny, nz FROM cr) GROUP BY 1,2),
nv AS (SELECT subject_id, vid, nx/sqrt(nx*nx+ny*ny+nz*nz) nx, ny/sqrt(nx*nx+ny*ny+nz*nz) ny, nz/sqrt(nx*nx+ny*ny+nz*nz) nz FROM ns)"""


@query("vertex_normals", with_(MESH, FV, NV, body="SELECT subject_id, vid, round(nx,6) AS nx, round(ny,6) AS ny, round(nz,6) AS nz FROM nv"))
def vertex_normals(spark, d):
    return rounded(H.vertex_normals(mesh_faces(spark, d), mesh_vertices(spark, d)), "nx", "ny", "nz")


@query("mesh_adjacency", with_(MESH, "mc AS (SELECT * FROM mv WHERE cortex)", "mf2 AS (SELECT f.* FROM mf f SEMI JOIN mc a ON a.subject_id=f.subject_id AND a.vid=v0 SEMI JOIN mc b ON b.subject_id=f.subject_id AND b.vid=v1 SEMI JOIN mc c ON c.subject_id=f.subject_id AND c.vid=v2)", DE.replace("FROM mf", "FROM mf2"), BE, body="SELECT DISTINCT subject_id, src, dst FROM be"))
def mesh_adjacency(spark, d):
    v = mesh_vertices(spark, d)
    return H.adjacency(H.inner_faces(mesh_faces(spark, d), v.filter("cortex")))


SAME = "sa AS (SELECT b.subject_id, b.src, b.dst, count(*) AS n_faces FROM be b JOIN mv p ON p.subject_id=b.subject_id AND p.vid=b.src JOIN mv q ON q.subject_id=b.subject_id AND q.vid=b.dst WHERE p.label=q.label GROUP BY 1,2,3)"


@query("same_label_adjacency", with_(MESH, DE, BE, SAME, body="SELECT * FROM sa"))
def same_label_adjacency(spark, d):
    return H.same_label_adjacency(mesh_faces(spark, d), mesh_vertices(spark, d))


@query("label_islands", with_(MESH, DE, BE, SAME, """rc AS (SELECT subject_id, vid AS id, vid AS c FROM mv UNION SELECT rc.subject_id, sa.dst, rc.c FROM rc JOIN sa ON sa.subject_id=rc.subject_id AND sa.src=rc.id WHERE rc.c < sa.dst),
cp AS (SELECT subject_id, id AS vid, min(c) AS c FROM rc GROUP BY 1,2), cl AS (SELECT cp.*, label FROM cp JOIN mv USING (subject_id, vid)),
bs AS (SELECT subject_id, label, c FROM cl GROUP BY 1,2,3 QUALIFY row_number() OVER (PARTITION BY subject_id, label ORDER BY count(*) DESC, c)=1)""", body="SELECT subject_id, vid, label FROM cl ANTI JOIN bs USING (subject_id, label, c)", recursive=True))
def label_islands(spark, d):
    v = mesh_vertices(spark, d)
    return H.label_islands(mesh_faces(spark, d), v.select("subject_id", "vid", "label"))


R2 = "r2 AS (SELECT DISTINCT a.subject_id, a.src, b.dst FROM rg a JOIN rg b ON a.subject_id=b.subject_id AND a.dst=b.src), r4 AS (SELECT DISTINCT a.subject_id, a.src, b.dst FROM r2 a JOIN r2 b ON a.subject_id=b.subject_id AND a.dst=b.src)"


@query("ring_4_sizes", with_(MESH, DE, BE, RING, R2, body="SELECT subject_id, src, count(*) AS n FROM r4 GROUP BY 1,2"))
def ring_4_sizes(spark, d):
    return H.ring(H.adjacency(mesh_faces(spark, d)), 4).groupBy("subject_id", "src").agg(F.count(F.lit(1)).alias("n"))


def vote(ring, labels, out, where="true"):
    return f"""{out} AS (SELECT v.subject_id, v.vid, coalesce(w.label, v.label) AS label FROM {labels} v LEFT JOIN (SELECT r.subject_id, r.src AS vid, l.label FROM {ring} r JOIN {labels} l ON l.subject_id=r.subject_id AND l.vid=r.dst
 WHERE {where} GROUP BY 1,2,3 QUALIFY row_number() OVER (PARTITION BY r.subject_id, r.src ORDER BY count(*) DESC, l.label)=1) w USING (subject_id, vid))"""


@query("mode_filter", with_(MESH, DE, BE, RING, vote("rg", "mv", "mo"), body="SELECT subject_id, vid, label FROM mo"))
def mode_filter(spark, d):
    v = mesh_vertices(spark, d).select("subject_id", "vid", "label")
    return H.mode_filter(H.ring(H.adjacency(mesh_faces(spark, d))), v)


@query("smooth_labels_full", with_(MESH, DE, BE, RING, R2, vote("r4", "mv", "m4"), vote("r2", "m4", "m2"), vote("rg", "m2", "m1"), body="SELECT subject_id, vid, label FROM m1"))
def smooth_labels_full(spark, d):
    v = mesh_vertices(spark, d)
    return H.smooth_labels(mesh_faces(spark, d), v.select("subject_id", "vid", "label"), v)


@query("smooth_labels_holes")
def smooth_labels_holes(spark, d):
    v = mesh_vertices(spark, d)
    holes = F.when(F.col("vid") % 5 < 3, 0).when(F.col("vid") % 11 == 0, -1).otherwise(F.col("label"))
    return H.smooth_labels(mesh_faces(spark, d), v.select("subject_id", "vid", holes.alias("label")), v.filter("cortex"))


def scaled_vertices(spark, d):
    """Mesh points spread over the sample volume."""
    v = mesh_vertices(spark, d)
    return v.select("subject_id", "vid", ((F.col("x") + 0.3) * 12).alias("x"), ((F.col("y") + 0.3) * 12).alias("y"), ((F.col("z") + 0.3) * 150).alias("z"), "label", "cortex")


def volume_matrix(spark, d):
    m = F.expr("array(array(1D,0D,0D,0D),array(0D,1D,0D,0D),array(0D,0D,1D,0D),array(0D,0D,0D,1D))")
    return mesh_vertices(spark, d).select("subject_id").distinct().withColumn("m", m)


SV = "sv AS (SELECT subject_id, vid, (x+0.3)*12 AS x, (y+0.3)*12 AS y, (z+0.3)*150 AS z, label, cortex FROM mv)"


@query("sample_volume_at_vertices", with_(MESH, EV, SV, FV.replace("JOIN mv", "JOIN sv"), NV, body="""
SELECT v.subject_id, v.vid, CAST(CASE WHEN v.cortex THEN coalesce(e.seg, 0) ELSE 0 END AS INT) AS label FROM sv v LEFT JOIN nv USING (subject_id, vid)
LEFT JOIN ev e ON e.subject_id=v.subject_id AND e.x=CAST(round_even(v.x+0.5*coalesce(nx,0),0) AS INT) AND e.y=CAST(round_even(v.y+0.5*coalesce(ny,0),0) AS INT) AND e.z=CAST(round_even(v.z+0.5*coalesce(nz,0),0) AS INT)"""))
def sample_volume_at_vertices(spark, d):
    v = scaled_vertices(spark, d)
    return H.sample_volume(v, mesh_faces(spark, d), ev(spark, d), volume_matrix(spark, d), v.filter("cortex"), 0.5)


@query("volume_to_surface")
def volume_to_surface(spark, d):
    v = scaled_vertices(spark, d)
    return H.volume_to_surface(v, mesh_faces(spark, d), ev(spark, d), volume_matrix(spark, d), v.filter("cortex"), 0.5, 2.0)


def named_labels(v):
    """Sparse label sets on the source half of the mesh."""
    name = F.when(F.col("label") % 4 == 0, "unknown").otherwise(F.concat(F.lit("area"), F.col("label").cast("string")))
    value = F.floor(F.col("x") * 100).cast("double")
    first = v.select("subject_id", name.alias("name"), "vid", value.alias("value"))
    return first.unionByName(first.withColumn("name", F.lit("area0")).withColumn("value", F.abs("value")))


NL = """nl AS (SELECT subject_id, CASE WHEN label%4=0 THEN 'unknown' ELSE 'area'||label END AS name, vid, floor(x*100)::DOUBLE AS value FROM mv WHERE vid<250
 UNION ALL SELECT subject_id, 'area0', vid, abs(floor(x*100))::DOUBLE FROM mv WHERE vid<250),
nn AS (SELECT q.subject_id, q.vid, arg_min(t.vid, (q.x-t.x)**2+(q.y-t.y)**2+(q.z-t.z)**2) AS src FROM mv q JOIN mv t ON t.subject_id=q.subject_id AND q.vid>=250 AND t.vid<250 GROUP BY 1,2),
tl AS (SELECT nn.subject_id, name, nn.vid, value FROM nn JOIN nl ON nl.subject_id=nn.subject_id AND nl.vid=nn.src WHERE name<>'unknown')"""


def transferred(spark, d):
    v = mesh_vertices(spark, d)
    pairs = H.correspondence(v.filter("vid >= 250"), v.filter("vid < 250"))
    return H.transfer_labels(pairs, named_labels(v.filter("vid < 250")))


@query("transfer_labels", with_(MESH, NL, body="SELECT * FROM tl"))
def transfer_labels(spark, d):
    return transferred(spark, d)


@query("build_annotation", with_(MESH, NL, body="""
SELECT v.subject_id, v.vid, CAST(CASE WHEN NOT cortex THEN -1 ELSE coalesce(w.col_id,0) END AS INT) AS label, coalesce(w.value,0) AS value FROM mv v
LEFT JOIN (SELECT subject_id, vid, value, 10+substr(name,5)::INT AS col_id FROM tl WHERE value>=0 QUALIFY row_number() OVER (PARTITION BY subject_id, vid ORDER BY value DESC, substr(name,5)::INT DESC)=1) w USING (subject_id, vid) WHERE v.vid>=250"""))
def build_annotation(spark, d):
    v = mesh_vertices(spark, d)
    labels = transferred(spark, d)
    pos = F.substring("name", 5, 10).cast("int")
    order = named_labels(v).select("name").distinct().filter("name <> 'unknown'").select("name", pos.alias("pos"), (pos + 10).alias("col_id"))
    return H.build_annotation(v.filter("vid >= 250"), labels, order, v.filter("cortex"))


@query("project_to_sphere", with_(MESH, body="SELECT subject_id, vid, round(100*x/sqrt(x*x+y*y+z*z),6) AS x, round(100*y/sqrt(x*x+y*y+z*z),6) AS y, round(100*z/sqrt(x*x+y*y+z*z),6) AS z FROM mv"))
def project_to_sphere(spark, d):
    return rounded(H.to_sphere(mesh_vertices(spark, d).select("subject_id", "vid", "x", "y", "z")), "x", "y", "z")


@query("joint_label_intersection", with_(EV, "jl AS (SELECT DISTINCT subject_id, blk AS l FROM ev WHERE blk>0 INTERSECT SELECT DISTINCT subject_id, seg FROM ev WHERE seg>0)", body="SELECT subject_id, l AS seg FROM jl"))
def joint_label_intersection(spark, d):
    v = ev(spark, d)
    return v.filter("blk > 0").select("subject_id", F.col("blk").alias("seg")).intersect(v.filter("seg > 0").select("subject_id", "seg"))


def moved_points(spark, d):
    v = mesh_vertices(spark, d)
    return v.select("subject_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), (0.5 - F.col("y")).alias("qx"), (F.col("x") + 2).alias("qy"), (F.col("z") - 1).alias("qz"))


def matrix_rows(df, digits=5):
    rows = df.select("subject_id", F.posexplode("m").alias("r", "row")).select("subject_id", "r", F.posexplode("row").alias("c", "v"))
    return rows.withColumn("v", F.round(F.col("v"), digits) + 0.0)


KNOWN = "SELECT subject_id, CAST(i//4 AS INT) AS r, CAST(i%4 AS INT) AS c, ([0,-1,0,{t[0]},1,0,0,{t[1]},0,0,1,{t[2]},0,0,0,1])[i+1]::DOUBLE AS v FROM (SELECT DISTINCT subject_id FROM mv), (SELECT unnest(range(0,16)) i)"


@query("rigid_fit", with_(MESH, body=KNOWN.format(t=(0.5, 2, -1))))
def rigid_fit(spark, d):
    return matrix_rows(N.fit_transform(moved_points(spark, d), "rigid"))


@query("affine_fit", with_(MESH, body=KNOWN.format(t=(0.5, 2, -1))))
def affine_fit(spark, d):
    return matrix_rows(N.fit_transform(moved_points(spark, d), "affine"))


@query("align_spheres", with_(MESH, body=KNOWN.format(t=(0, 0, 0))))
def align_spheres(spark, d):
    v = mesh_vertices(spark, d)
    turned = v.select("subject_id", "vid", "label", (-F.col("y")).alias("x"), F.col("x").alias("y"), "z")
    return matrix_rows(N.align_spheres(v, turned))


@query("point_moments", with_(MESH, body="SELECT subject_id, count(*)::DOUBLE AS n, round(sum(x),6) AS sx, round(sum(y*(x+2)),6) AS py_qy, round(sum(z*z),6) AS pz_pz FROM mv GROUP BY 1"))
def point_moments(spark, d):
    m = N.point_moments(moved_points(spark, d))
    return m.select("subject_id", "n", F.round("s_px", 6).alias("sx"), F.round("py_qy", 6).alias("py_qy"), F.round("pz_pz", 6).alias("pz_pz"))


@query("align_label_centroids", with_(EV, body="SELECT subject_id, CAST(i//4 AS INT) AS r, CAST(i%4 AS INT) AS c, ([1,0,0,2,0,1,0,0,0,0,1,-3,0,0,0,1])[i+1]::DOUBLE AS v FROM (SELECT DISTINCT subject_id FROM ev), (SELECT unnest(range(0,16)) i)"))
def align_label_centroids(spark, d):
    v = ev(spark, d).filter("blk > 0").select("subject_id", "x", "y", "z", F.col("blk").alias("seg"))
    return matrix_rows(N.align_centroids(v, v.withColumn("x", F.col("x") + 2).withColumn("z", F.col("z") - 3)))


@query("align_flipped")
def align_flipped(spark, d):
    v = ev(spark, d).filter("blk > 0")
    sides = v.select("blk").distinct().filter("blk IN (1, 3)").select(F.col("blk").alias("src"), (F.col("blk") + 1).alias("dst"))
    return matrix_rows(N.align_flipped(v, sides, ev_dims(spark, d), "blk"))
