"""Text sources and sinks, logs, timings, regression and quality checks."""

import uuid

from pyspark.sql import functions as F

from volspark.functions.scalars import minutes, split_measure, strip_prefix, version_numbers
from volspark.operators import logs as L
from volspark.operators import regions as R
from volspark.plans.storage import shared_folder
from volspark.queries.fixtures import BAG, BAG_VOX, EV, LINES, STAGES, bag, bag_headers, bag_lut, ev, ev_dims, log_lines, stages, table, with_
from volspark.queries.region_tables import BASIC, rounded
from volspark.queries.registry import query
from volspark.sources import manifest as M
from volspark.sources import settings as Y
from volspark.sources import tables as T
from volspark.sources.text import numbered_lines, small_text_lines


def scratch(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/volspark/{name}-{uuid.uuid4().hex}"


# --- sources and sinks -------------------------------------------------------------------------------

PART_LINE = "SELECT p_partkey, CASE WHEN p_partkey%50=0 THEN '# '||p_name WHEN p_partkey%50=1 THEN '' ELSE p_partkey||'  '||replace(p_name,' ','_')||' '||(p_partkey%256)||'   '||p_size||' 7 0' END AS line FROM part"


def part_lines(spark, d, sep):
    k = F.col("p_partkey")
    name = F.regexp_replace("p_name", " ", "_")
    text = F.concat_ws(sep, k.cast("string"), name, (k % 256).cast("string"), F.col("p_size").cast("string"), F.lit("7"), F.lit("0"))
    line = F.when(k % 50 == 0, F.concat(F.lit("# "), "p_name")).when(k % 50 == 1, "").otherwise(text)
    return table(spark, d, "part").select(line.alias("value"))


LUT_SQL = """SELECT CAST(p_partkey AS INT) AS id, replace(p_name,' ','_') AS label_name, CAST(p_partkey%256 AS INT) AS r, p_size AS g, 7 AS b, 0 AS a, kind FROM part, (SELECT unnest(['txt','csv','tsv']) AS kind) WHERE p_partkey%50 > 1"""


@query("read_lut", LUT_SQL)
def read_lut(spark, d):
    out = None
    for kind, sep in (("txt", "  "), ("csv", ", "), ("tsv", "\t")):
        path = scratch(spark, "lut") + "." + kind
        part_lines(spark, d, sep).write.text(path)
        rows = T.read_lut(spark, path).withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("read_json_lut", "SELECT c_mktsegment AS grp, c_name AS src, CAST(c_nationkey AS VARCHAR) AS dst FROM customer")
def read_json_lut(spark, d):
    c = table(spark, d, "customer")
    entries = F.map_from_entries(F.collect_list(F.struct("c_name", F.col("c_nationkey").cast("string"))))
    texts = c.groupBy(F.col("c_mktsegment").alias("grp"), F.floor(F.col("c_custkey") / 100).alias("part")).agg(entries.alias("m"))
    texts = texts.select("grp", F.to_json(F.struct(F.col("m").alias("labels"))).alias("value"))
    return T.parse_json_lut(texts)


@query("numbered_lines", with_(LINES, body="SELECT lang, count(*) AS n, count(DISTINCT line) AS kinds, CAST(count(*) AS BIGINT) AS numbers FROM lines JOIN documents USING (doc_id) GROUP BY 1"))
def numbered_text_lines(spark, d):
    path = scratch(spark, "lines")
    docs = table(spark, d, "documents").select("doc_id", "lang")
    lines = log_lines(spark, d).join(docs, "doc_id").select("lang", "line")
    lines.write.partitionBy("lang").text(path)
    got = numbered_lines(spark, path)
    lang = F.regexp_extract("file", "lang=([^/]+)/", 1)
    return got.groupBy(lang.alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("line").alias("kinds"), F.countDistinct("file", "line_no").alias("numbers"))


def bag_stats(spark, d):
    return R.region_stats(bag(spark, d), bag_headers(spark, d), bag_lut(spark, d))


STAT_SQL = """st AS (SELECT subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY seg) AS row_index, seg, n_voxels, volume, coalesce(n_name,'Unknown-Label') AS struct_name, v_mean, v_std, v_min, v_max, v_max-v_min AS v_range
 FROM pv JOIN nation ON seg=n_nationkey)"""


COLUMN_LINES = [
    line
    for i, (name, field, unit) in enumerate(
        [("Index", "Index", "NA"), ("SegId", "Segmentation Id", "NA"), ("NVoxels", "Number of Voxels", "unitless"), ("Volume_mm3", "Volume", "mm^3"), ("StructName", "Structure Name", "NA"),
         *((f"norm{n}", f"Intensity norm{n}", "MR") for n in ("Mean", "StdDev", "Min", "Max", "Range"))], 1)
    for line in (f"# TableCol {i:>2d} ColHeader {name}", f"# TableCol {i:>2d} FieldName {field}", f"# TableCol {i:>2d} Units     {unit}")
]


def stats_text_sql():
    """Every line of a statistics file, with its place."""
    top = ["# Title Segmentation Statistics", "#", "# Only reporting non-empty segmentations", "# compatibility: fixed"]
    fixed = [(k, t) for k, t in enumerate(top)] + [(10 + k, t) for k, t in enumerate(COLUMN_LINES)]
    fixed += [(51, "# NTableCols 10"), (52, "# ColHeaders  Index SegId NVoxels Volume_mm3 StructName normMean normStdDev normMin normMax normRange")]
    values = ", ".join(f"({k}, '{t}')" for k, t in fixed)
    return f"""tx AS (SELECT subject_id, k, t AS line FROM (SELECT DISTINCT subject_id FROM st), (VALUES {values}) v(k, t)
UNION ALL SELECT subject_id, 5, '# VoxelVolume_mm3 '||CAST(({BAG_VOX})::DOUBLE AS VARCHAR) FROM st GROUP BY ALL
UNION ALL SELECT subject_id, 50, printf('# NRows %2d', count(*)) FROM st GROUP BY 1
UNION ALL SELECT subject_id, 100+row_index, printf('%3d %3d %9d %10.1f  %-30s %10.4f %10.4f %10.4f %10.4f %10.4f', row_index, seg, n_voxels, volume::DOUBLE, struct_name, v_mean, v_std, v_min::DOUBLE, v_max::DOUBLE, v_range::DOUBLE) FROM st)"""


@query("write_stats_lines", with_(BAG, BASIC, STAT_SQL, stats_text_sql(), body="SELECT subject_id, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY k) AS INT) AS line_no, line FROM tx"))
def write_stats_lines(spark, d):
    return T.stat_lines(bag_stats(spark, d), bag_headers(spark, d)).select("subject_id", "line_no", "line")


@query("stats_text_round_trip", with_(BAG, BASIC, STAT_SQL, body="""SELECT subject_id, CAST(row_index AS INT) AS "Index", seg AS "SegId", n_voxels AS "NVoxels", round(volume,1)::DOUBLE AS "Volume_mm3", struct_name AS "StructName",
 round(v_mean,3)::DOUBLE AS "normMean", round(v_std,3)::DOUBLE AS "normStdDev", v_min::DOUBLE AS "normMin", v_max::DOUBLE AS "normMax", v_range::DOUBLE AS "normRange" FROM st"""))
def stats_text_round_trip(spark, d):
    path = scratch(spark, "stats")
    T.write_stat_files(T.stat_lines(bag_stats(spark, d), bag_headers(spark, d)), path)
    out = T.stat_table(small_text_lines(spark, path))
    subject = F.regexp_extract("file", "subject_id=([^/]+)/", 1).cast("bigint")
    return out.select(subject.alias("subject_id"), "Index", "SegId", "NVoxels", "Volume_mm3", "StructName", F.round("normMean", 3).alias("normMean"), F.round("normStdDev", 3).alias("normStdDev"), "normMin", "normMax", "normRange")


def simple_measures(spark, d):
    n = bag(spark, d).groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"), F.avg("norm").alias("m"))
    rows = F.explode(F.array(
        F.struct(F.lit("Count").alias("key"), F.lit("VoxelCount").alias("name"), F.lit("Number of voxels").alias("description"), F.col("n").cast("double").alias("value"), F.lit(True).alias("is_int"), F.lit("unitless").alias("unit")),
        F.struct(F.lit("Mean").alias("key"), F.lit("MeanValue").alias("name"), F.lit("Mean intensity").alias("description"), F.round("m", 3).alias("value"), F.lit(False).alias("is_int"), F.lit("MR").alias("unit")),
    ))
    return n.select("subject_id", rows.alias("r")).select("subject_id", "r.*")


@query("format_measures", with_(BAG, body="""SELECT subject_id, 'Count' AS key, '# Measure Count, VoxelCount, Number of voxels, '||count(*)||', unitless' AS line FROM bag GROUP BY 1
UNION ALL SELECT subject_id, 'Mean', '# Measure Mean, MeanValue, Mean intensity, '||printf('%.6f', round(avg(norm),3))||', MR' FROM bag GROUP BY 1"""))
def format_measures(spark, d):
    return T.format_measures(simple_measures(spark, d)).select("subject_id", "key", "line")


@query("measures_round_trip", with_(BAG, body=f"""SELECT subject_id, 'Count' AS key, 'VoxelCount' AS name, count(*)::DOUBLE AS value, true AS is_int, 'unitless' AS unit FROM bag GROUP BY 1
UNION ALL SELECT subject_id, 'Mean', 'MeanValue', round(avg(norm),3), false, 'MR' FROM bag GROUP BY 1
UNION ALL SELECT subject_id, 'vox_vol', 'Voxel volume', any_value({BAG_VOX}), false, 'mm^3' FROM bag GROUP BY 1"""))
def measures_round_trip(spark, d):
    lines = T.stat_lines(bag_stats(spark, d), bag_headers(spark, d), simple_measures(spark, d))
    return T.parse_measures(lines, ["subject_id"]).select("subject_id", "key", "name", "value", "is_int", "unit")


@query("subject_manifest", """SELECT regexp_extract(replace(url,'.html',''), '([^/]*)/?$', 1) AS subject_id, url AS path FROM pages WHERE page_id%2=0
UNION ALL SELECT regexp_extract('p'||page_id, '([^/]*)$', 1), '/base/p'||page_id||'.mgz' FROM pages WHERE page_id%2=1""")
def subject_manifest(spark, d):
    p = table(spark, d, "pages")
    listed = scratch(spark, "list")
    k = F.col("page_id")
    p.select(F.when(k % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("p"), k.cast("string"), F.lit(".mgz")))).write.text(listed)
    rows = M.subject_manifest(spark, list_file=listed, base="/base/")
    suffix = F.when(F.col("path").startswith("/base"), M.subject_of("path", ".mgz")).otherwise(M.subject_of("path", ".html"))
    return rows.select(suffix.alias("subject_id"), "path")


@query("subject_modes", "SELECT 'folder' AS mode, 'source='||source AS subject_id, count(DISTINCT doc_id) > 0 AS found FROM documents WHERE source IS NOT NULL GROUP BY source UNION ALL SELECT 'single', 'source=a.mgz', true FROM (SELECT 1 FROM documents LIMIT 1)")
def subject_modes(spark, d):
    """The files of a folder that match a pattern, and one path; each with the subject's name."""
    path = scratch(spark, "subjects")
    table(spark, d, "documents").filter("source IS NOT NULL").select("source", F.col("doc_id").cast("string").alias("value")).write.partitionBy("source").text(path)
    files = M.subject_manifest(spark, folder=path, glob="*.txt")
    parents = files.select(F.regexp_extract("path", "/(source=[^/]+)/[^/]*$", 1).alias("subject_id")).distinct()
    single = M.subject_manifest(spark, single=f"{path}/source=a.mgz/", suffix="x")
    both = parents.withColumn("mode", F.lit("folder")).unionByName(single.select("subject_id").withColumn("mode", F.lit("single")))
    return both.select("mode", F.url_decode("subject_id").alias("subject_id"), F.lit(True).alias("found"))


@query("common_suffix", "SELECT CASE WHEN min(e) = max(e) AND count(*) > 1 THEN '-'||min(e)||'/x.mgz' ELSE '/x.mgz' END AS suffix FROM (SELECT chr(CAST(97 + page_id % 3 AS INT)) AS e FROM pages)")
def common_suffix(spark, d):
    end = F.element_at(F.array(*(F.lit(c) for c in "abc")), (F.col("page_id") % 3 + 1).cast("int"))
    return M.common_suffix(table(spark, d, "pages").select(F.concat("url", F.lit("-"), end, F.lit("/x.mgz")).alias("path")))


@query("lut_files", "SELECT 'tsv' AS kind, s_suppkey::VARCHAR AS src, s_name AS dst FROM supplier UNION ALL SELECT 'json', c_name, c_nationkey::VARCHAR FROM customer")
def lut_files(spark, d):
    """A tab-separated lookup table with its header row, and name maps in JSON files, one object per file."""
    tsv, json = scratch(spark, "lut") + ".tsv", scratch(spark, "json")
    head = spark.range(1).select(F.lit("ID\tLabelName\tR\tG\tB\tA").alias("value"))
    rows = table(spark, d, "supplier").select(F.concat_ws("\t", F.col("s_suppkey").cast("string"), "s_name", F.lit("1"), F.lit("2"), F.lit("3"), F.lit("0")).alias("value"))
    head.unionByName(rows).write.text(tsv)
    c = table(spark, d, "customer")
    entries = F.map_from_entries(F.collect_list(F.struct("c_name", F.col("c_nationkey").cast("string"))))
    texts = c.groupBy(F.floor(F.col("c_custkey") / 500).alias("part")).agg(F.to_json(F.struct(entries.alias("labels"))).alias("value"))
    texts.repartition("part").write.partitionBy("part").text(json)
    names = T.read_lut(spark, tsv).select(F.lit("tsv").alias("kind"), F.col("id").cast("string").alias("src"), F.col("label_name").alias("dst"))
    return names.unionByName(T.read_json_lut(spark, json).select(F.lit("json").alias("kind"), "src", "dst"))


@query("batch_list_lines", "SELECT page_id, 'sub'||page_id AS id, regexp_extract(url||'=a', '^[^\\s\"'']+') AS path, 'some words' AS arg1, '--n' AS arg2 FROM pages")
def batch_list_lines(spark, d):
    p = table(spark, d, "pages")
    text = F.concat(F.lit("sub"), F.col("page_id").cast("string"), F.lit("="), "url", F.lit("=a \"some words\" --n"))
    out = M.parse_batch_lines(p.select("page_id", text.alias("line")))
    return out.select("page_id", "id", "path", F.get("args", F.lit(0)).alias("arg1"), F.get("args", F.lit(1)).alias("arg2"))


@query("pairing_lines", """SELECT 'c'||c_custkey AS fixed, CAST(i-1 AS INT) AS pos, 'm'||(c_nationkey+i-1) AS moving, 'm'||(c_nationkey+i-1)||'_to_c'||c_custkey AS folder
FROM customer, (SELECT unnest(range(1,4)) i) WHERE i <= 1+c_custkey%3""")
def pairing_lines(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    items = F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda i: F.concat(F.lit("m"), (n + i).cast("string")))
    line = F.concat(F.lit("c"), k.cast("string"), F.lit(","), F.concat_ws(" , ", items))
    return M.parse_pairings(table(spark, d, "customer").select(line.alias("line")))


@query("template_time_points", "SELECT o_orderkey AS time_point, o_custkey AS base_id, c_name AS template FROM orders JOIN customer ON c_custkey=o_custkey")
def template_time_points(spark, d):
    points = table(spark, d, "orders").select(F.col("o_orderkey").alias("time_point"), F.col("o_custkey").alias("base_id"))
    return M.pair_time_points(points, table(spark, d, "customer").select(F.col("c_custkey").alias("base_id"), F.col("c_name").alias("template")))


XFM = """SELECT s_suppkey AS subject_id, CAST(i//4 AS INT) AS r, CAST(i%4 AS INT) AS c, (CASE WHEN i<12 THEN (s_suppkey+i)/4.0 WHEN i=15 THEN 1 ELSE 0 END)::DOUBLE AS v FROM supplier, (SELECT unnest(range(0,16)) i)"""


def xfm_lines(spark, d, head, mark, end):
    k = F.col("s_suppkey")
    rows = [F.concat_ws(" ", *(((k + 4 * r + c) / 4.0).cast("string") for c in range(4))) for r in range(3)]
    tail = [F.concat(t, F.lit(end)) for t in rows] + [F.lit("0 0 0 1")]
    parts = F.array(*(F.lit(h) for h in head), F.lit(mark), *tail)
    return table(spark, d, "supplier").select(k.alias("subject_id"), F.posexplode(parts).alias("line_no", "line"))


def long_matrix(df):
    rows = df.select("subject_id", F.posexplode("m").alias("r", "row"))
    return rows.select("subject_id", "r", F.posexplode("row").alias("c", "v"))


@query("xfm_matrix", XFM)
def xfm_matrix(spark, d):
    return long_matrix(T.parse_xfm(xfm_lines(spark, d, ["MNI Transform File", "% made"], "Linear_Transform =", ";"), ["subject_id"]))


@query("lta_matrix", XFM)
def lta_matrix(spark, d):
    return long_matrix(T.parse_lta(xfm_lines(spark, d, ["type = 1", "nxforms = 1"], "1 4 4", ""), ["subject_id"]))


# --- logs --------------------------------------------------------------------------------------------

HIT = "contains(lower(line),'sch') AND NOT contains(lower(line),'the')"


@query("log_error_scan", with_(LINES, body=f"""SELECT h.doc_id, h.line_no AS hit, CAST(l.line_no-h.line_no AS INT) AS "at", l.line_no, l.line FROM (SELECT * FROM lines WHERE {HIT}) h
JOIN lines l ON l.doc_id=h.doc_id AND l.line_no-h.line_no BETWEEN -1 AND 3"""))
def log_error_scan(spark, d):
    return L.scan_errors(log_lines(spark, d), ["SCH"], ["the"], ["doc_id"])


def settings_file(spark, text):
    """A settings file as a person writes one."""
    path = scratch(spark, "settings")
    spark.range(1).select(F.lit(text).alias("value")).write.text(path)
    return path


@query("log_error_scan_settings", with_(LINES, body=f"""SELECT h.doc_id, h.line_no AS hit, CAST(l.line_no-h.line_no AS INT) AS "at", l.line_no, l.line FROM (SELECT * FROM lines WHERE {HIT}) h
JOIN lines l ON l.doc_id=h.doc_id AND l.line_no-h.line_no BETWEEN -1 AND 3"""))
def log_error_scan_settings(spark, d):
    words, harmless = Y.read_words(spark, settings_file(spark, "errors:\n - \"SCH\"  # in any case\n\nwhitelist:\n  - 'the'\n"))
    return L.scan_errors(log_lines(spark, d), words, harmless, ["doc_id"])


HEADED = "hl AS (SELECT doc_id, line_no, CASE WHEN line_no%7=3 THEN '====== '||line||' ======' WHEN line_no%11=5 THEN '====== DONE' WHEN line_no%13=2 THEN '====== iteration 5' ELSE line END AS line FROM lines)"


def headed_lines(spark, d):
    n = F.col("line_no")
    text = F.when(n % 7 == 3, F.concat(F.lit("====== "), "line", F.lit(" ======"))).when(n % 11 == 5, "====== DONE").when(n % 13 == 2, "====== iteration 5")
    return log_lines(spark, d).withColumn("line", F.coalesce(text, "line"))


@query("log_sections", with_(LINES, HEADED, "nm AS (SELECT *, CASE WHEN contains(line,'======') AND NOT contains(line,'teration') AND trim(line,'= ')<>'DONE' THEN replace(trim(trim(line,'= ')),' ','-') END AS nm FROM hl)", body="""
SELECT doc_id, line_no, last_value(nm IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM nm"""))
def log_sections(spark, d):
    return L.sections(headed_lines(spark, d), ["doc_id"], chunk=16).drop("line")


def timing_text(spark, d):
    """Log lines from events: a command line and a timing line each."""
    e = table(spark, d, "events")
    stamp = F.date_format("ts", "yyyy:MM:dd:HH:mm:ss")
    command = F.concat("event_type", F.lit(" --value "), F.col("value").cast("string"), F.when(F.col("event_id") % 9 == 0, " done").otherwise(" run"))
    timing = F.concat(F.lit("@#@FSTIME "), stamp, F.lit(" "), "event_type", F.lit(" N 2 e "), F.col("value").cast("string"), F.lit(" S 0.05 U 1.64 P 77% M 236 F 0 R 55 W 0 c 7 w 3 I 0 O 20"))
    lines = F.posexplode(F.array(command, timing)).alias("p", "line")
    rows = e.select(F.col("user_id").alias("subject_id"), "event_id", lines)
    return rows.select("subject_id", (F.col("event_id") * 2 + F.col("p")).cast("int").alias("line_no"), "line")


@query("command_times", """WITH e AS (SELECT user_id AS subject_id, event_id, event_type AS cmd, date_trunc('second', ts) AS start, value,
 last_value(CASE WHEN event_id%9<>0 THEN event_type||' --value '||value||' run' END IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS command FROM events)
SELECT subject_id, CAST(event_id*2+1 AS INT) AS line_no, cmd, command, epoch(start)::BIGINT AS start_s, value AS elapsed_s FROM e WHERE command IS NOT NULL""")
def command_times(spark, d):
    out = L.command_times(timing_text(spark, d), ["subject_id"], chunk=1024)
    return out.select("subject_id", "line_no", "cmd", "command", F.unix_timestamp("start").alias("start_s"), "elapsed_s")


@query("timing_fields", "SELECT user_id AS subject_id, CAST(event_id*2+1 AS INT) AS line_no, event_type AS cmd, value AS elapsed_s, 77.0::DOUBLE AS cpu_percent, CAST(236 AS BIGINT) AS max_kb, CAST(20 AS BIGINT) AS outputs FROM events")
def timing_fields(spark, d):
    return L.timing_lines(timing_text(spark, d)).select("subject_id", "line_no", "cmd", "elapsed_s", "cpu_percent", "max_kb", "outputs")


@query("stage_durations", with_(STAGES, body="SELECT subject_id, event_id, stage, round((lead(us) OVER (PARTITION BY subject_id ORDER BY us, event_id)-us)/1e6,6) AS duration_s FROM stages"))
def stage_durations(spark, d):
    out = L.stage_durations(stages(spark, d))
    return out.select("subject_id", "event_id", "stage", F.round("duration_s", 6).alias("duration_s"))


def staged_text(spark, d):
    """Logs of one command per ten events: its line, six stage marks, an ``Ended`` line and its timing line."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", (F.col("event_id") % 10).alias("k"), "ts")
    date = F.date_format("ts", "EEE MMM d HH:mm:ss 'UTC' yyyy")
    timing = F.concat(F.lit("@#@FSTIME "), F.date_format("ts", "yyyy:MM:dd:HH:mm:ss"), F.lit(" recon-all N 2 e "), F.col("value").cast("string"), F.lit(" S 0.05 U 1.64 P 77% M 236 F 0 R 55 W 0 c 7 w 3 I 0 O 20"))
    line = (
        F.when(F.col("k") == 1, F.concat(F.lit(" /bin/recon-all -s "), F.col("event_id").cast("string")))
        .when(F.col("k").between(2, 7), F.concat(F.lit("#@# "), "event_type", F.lit(" part "), date))
        .when(F.col("k") == 8, F.concat(F.lit("recon-all-status: Ended "), date))
        .when(F.col("k") == 9, timing).otherwise("#@# 241395 lh 227149")
    )
    return e.select(F.col("user_id").alias("subject_id"), F.col("event_id").alias("line_no"), line.alias("line"))


@query("command_stages", """WITH e AS (SELECT user_id AS subject_id, event_id, event_type||' part' AS stage, epoch(date_trunc('second', ts))::BIGINT AS s, event_id%10 AS k FROM events),
sp AS (SELECT t.subject_id, t.event_id AS timed_at, max(c.event_id) AS c0 FROM e t JOIN e c ON c.subject_id=t.subject_id AND c.k=1 AND c.event_id<t.event_id WHERE t.k=9 GROUP BY 1,2),
mk AS (SELECT sp.subject_id, timed_at, c0, m.event_id, m.s, m.k, CASE WHEN m.k<8 THEN {'stage': stage, 's': s} END AS st FROM sp JOIN e m ON m.subject_id=sp.subject_id AND m.event_id>=c0 AND m.event_id<timed_at AND m.k BETWEEN 2 AND 8),
op AS (SELECT *, last_value(st IGNORE NULLS) OVER (PARTITION BY subject_id, timed_at ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM mk)
SELECT subject_id, timed_at, '/bin/recon-all -s '||c0 AS command, event_id AS line_no, o.stage AS stage, o.s AS start_s, s AS stop_s, (s-o.s)::DOUBLE AS duration_s FROM op WHERE o IS NOT NULL""")
def command_stages(spark, d):
    out = L.command_stages(staged_text(spark, d), ["subject_id"], chunk=64)
    seconds = lambda c: F.unix_timestamp(c).alias(f"{c}_s")
    return out.select("subject_id", "timed_at", "command", "line_no", "stage", seconds("start"), seconds("stop"), "duration_s")


# --- regression and quality --------------------------------------------------------------------------

PAIR = """t AS (SELECT subject_id, seg, count(*)::DOUBLE n, avg(norm) m FROM bag WHERE l_discount < 0.05 AND seg<>3 GROUP BY 1,2),
r AS (SELECT subject_id, seg, (CASE WHEN seg=5 THEN 0 ELSE count(*) END)::DOUBLE n, avg(norm) m FROM bag GROUP BY 1,2),
j AS (SELECT coalesce(t.subject_id,r.subject_id) subject_id, coalesce(t.seg,r.seg) seg, t.n tn, r.n rn, t.m tm, r.m rm FROM t FULL JOIN r ON t.subject_id=r.subject_id AND t.seg=r.seg),
u AS (SELECT subject_id, seg, 'n' AS "column", tn AS test, rn AS reference FROM j UNION ALL SELECT subject_id, seg, 'm', tm, rm FROM j)"""


@query("stats_regression", with_(BAG, PAIR, body="""SELECT subject_id, seg, "column", round(test,6) AS test, round(reference,6) AS reference, round(abs(test/nullif(reference,0)-1),6) AS off FROM u LEFT JOIN nation ON n_nationkey=seg
WHERE test IS NULL OR reference IS NULL OR (reference<>0 AND abs(test/reference-1) > CASE WHEN n_regionkey=1 THEN 0.1 ELSE 0.01 END)"""))
def stats_regression(spark, d):
    b = bag(spark, d)
    agg = [F.count(F.lit(1)).alias("n"), F.avg("norm").alias("m")]
    test = b.filter("l_discount < 0.05 AND seg <> 3").groupBy("subject_id", "seg").agg(*agg)
    ref = b.groupBy("subject_id", "seg").agg(*agg).withColumn("n", F.when(F.col("seg") == 5, 0).otherwise(F.col("n")))
    loose = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("seg"), F.lit(0.1).alias("threshold"))
    out = L.compare_tables(test, ref, ["subject_id", "seg"], ["n", "m"], loose, "seg")
    return rounded(out, "test", "reference", "off")


@query("stats_regression_settings", with_(BAG, PAIR, body="""SELECT subject_id, seg, "column", round(test,6) AS test, round(reference,6) AS reference, round(abs(test/nullif(reference,0)-1),6) AS off FROM u
WHERE test IS NULL OR reference IS NULL OR (reference<>0 AND abs(test/reference-1) > CASE WHEN seg IN (2, 9, 14) THEN 0.1 ELSE 0.02 END)"""))
def stats_regression_settings(spark, d):
    b = bag(spark, d)
    agg = [F.count(F.lit(1)).alias("n"), F.avg("norm").alias("m")]
    test = b.filter("l_discount < 0.05 AND seg <> 3").groupBy("subject_id", "seg").agg(*agg)
    ref = b.groupBy("subject_id", "seg").agg(*agg).withColumn("n", F.when(F.col("seg") == 5, 0).otherwise(F.col("n")))
    text = "default_threshold: 0.02\n\nthresholds:\n  2: 0.1\n  9: 0.1\n  14: 0.1\n\nstructs: [2, 9,\n          14]\n"
    loose, default, _ = Y.read_thresholds(spark, settings_file(spark, text), "seg")
    out = L.compare_tables(test, ref, ["subject_id", "seg"], ["n", "m"], loose, "seg", default)
    return rounded(out, "test", "reference", "off")


@query("required_measures_missing", "SELECT c_nationkey AS subject_id, 'm'||(c_custkey%60) AS key FROM customer EXCEPT SELECT s_nationkey, 'm'||(s_suppkey%60) FROM supplier")
def required_measures_missing(spark, d):
    key = lambda c: F.concat(F.lit("m"), (F.col(c) % 60).cast("string")).alias("key")
    expected = table(spark, d, "customer").select(F.col("c_nationkey").alias("subject_id"), key("c_custkey")).distinct()
    return L.missing_rows(expected, table(spark, d, "supplier").select(F.col("s_nationkey").alias("subject_id"), key("s_suppkey")), ["subject_id", "key"])


@query("files_missing", "SELECT DISTINCT url AS rel_path FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id%3=0)")
def files_missing(spark, d):
    p = table(spark, d, "pages").select("page_id", F.col("url").alias("rel_path"))
    return L.missing_rows(p.select("rel_path").distinct(), p.filter("page_id % 3 = 0").select("rel_path"), ["rel_path"])


STATUS = "st AS (SELECT user_id AS subject_id, CASE WHEN event_id%2=0 THEN 'seg' ELSE 'surf' END AS stage, CASE WHEN event_type='error' THEN 'Failed' ELSE event_type END AS state, ts, event_id AS seq FROM events)"


def status(spark, d):
    k = F.col("event_id")
    state = F.when(F.col("event_type") == "error", "Failed").otherwise(F.col("event_type"))
    return table(spark, d, "events").select(
        F.col("user_id").alias("subject_id"), F.when(k % 2 == 0, "seg").otherwise("surf").alias("stage"), state.alias("state"), "ts", k.alias("seq")
    )


@query("last_status", with_(STATUS, body="SELECT subject_id, stage, arg_max(state, (ts, seq)) AS state FROM st GROUP BY 1,2"))
def last_status(spark, d):
    return L.last_status(status(spark, d))


@query("skip_failed_subjects", with_(STATUS, body="SELECT DISTINCT subject_id FROM st WHERE subject_id NOT IN (SELECT subject_id FROM st WHERE stage='seg' GROUP BY 1 HAVING arg_max(state, (ts, seq))='Failed')"))
def skip_failed_subjects(spark, d):
    return L.runnable(status(spark, d), "seg")


def flags(spark, d):
    heads = ev_dims(spark, d).select("subject_id", F.lit(170.0).alias("vox_vol"))
    return L.quality_flags(ev(spark, d), heads)


QC = "qc AS (SELECT subject_id, count(*) FILTER (seg>0)*170.0::DOUBLE/1e6 AS litres FROM ev GROUP BY 1)"


@query("volume_quality_flags", with_(EV, QC, body="SELECT subject_id, round(litres,6) AS litres, litres<0.7 AS failed FROM qc"))
def volume_quality_flags(spark, d):
    return rounded(flags(spark, d), "litres")


@query("quality_failure_ratio", with_(EV, QC, body="SELECT count(*) AS subjects, count(*) FILTER (litres<0.7) AS n_failed, round(count(*) FILTER (litres<0.7)/count(*),6) AS ratio FROM qc"))
def quality_failure_ratio(spark, d):
    return rounded(L.failure_ratio(flags(spark, d)), "ratio")


@query("append_status_rows", "SELECT user_id AS subject_id, count(*) AS n FROM events GROUP BY 1")
def append_status_rows(spark, d):
    path = scratch(spark, "status")
    rows = status(spark, d)
    for stage in ("seg", "surf"):
        M.append_status(rows.filter(F.col("stage") == stage), path)
    return spark.read.parquet(path).groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))


# --- scalar functions --------------------------------------------------------------------------------


@query("compact_id_lists", """WITH i AS (SELECT DISTINCT l_suppkey%10 AS g, l_partkey AS v FROM lineitem), r AS (SELECT g, v-row_number() OVER (PARTITION BY g ORDER BY v) AS k, v FROM i),
s AS (SELECT g, min(v) a, max(v) b FROM r GROUP BY g, k) SELECT g, string_agg(CASE WHEN a=b THEN ''||a ELSE a||'-'||b END, ',' ORDER BY a) AS text FROM s GROUP BY 1""")
def compact_id_lists(spark, d):
    ids = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("g"), F.col("l_partkey").alias("v"))
    return L.sequence_runs(ids, ["g"], "v")


@query("measure_strings", "SELECT c_custkey, 'M'||c_nationkey AS key, CAST(CASE WHEN c_custkey%3=0 THEN 0 ELSE 2 END AS INT) AS n_args, CASE WHEN c_custkey%3=0 THEN NULL ELSE c_name END AS first_arg FROM customer")
def measure_strings(spark, d):
    k = F.col("c_custkey")
    args = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("("), "c_name", F.lit(" , x=1)")))
    c = table(spark, d, "customer").withColumn("t", F.concat(F.lit("M"), F.col("c_nationkey").cast("string"), args))
    key, parts = split_measure("t")
    return c.select("c_custkey", key.alias("key"), F.size(parts).alias("n_args"), F.get(parts, F.lit(0)).alias("first_arg"))


@query("version_numbers", "SELECT p_partkey, CASE WHEN p_partkey%5=0 THEN NULL ELSE (p_partkey%9)||'.'||(p_partkey%4)||'.1' END AS version FROM part")
def version_strings(spark, d):
    k = F.col("p_partkey")
    text = F.concat(F.lit("a-b-c-"), (k % 9).cast("string"), F.lit("."), F.when(k % 5 == 0, "dev").otherwise((k % 4).cast("string")), F.lit(".1"))
    p = table(spark, d, "part").withColumn("t", text)
    return p.select("p_partkey", F.array_join(F.transform(version_numbers("t"), lambda n: n.cast("string")), ".").alias("version"))


@query("strip_name_prefix", "SELECT c_custkey, regexp_replace(c_name,'^Customer#','') AS bare, round_even(c_custkey/60,2) AS minutes FROM customer")
def strip_name_prefix(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", strip_prefix("c_name", "Customer#").alias("bare"), minutes("c_custkey").alias("minutes"))

