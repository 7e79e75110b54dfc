"""Sources and sinks by round trips: what is written to the shared folder and read back is what the tables hold."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import expr
from ..operators import graph, joins, lossmaps, raster, surfaces
from ..sources import files, images
from .registry import query


def _folder(t) -> str:
    return f"{graph.shared_folder(t('region').sparkSession)}/stores-{uuid.uuid4().hex}"


@query(
    "A03 A05 B01 B02 B16 C01",
    """WITH p AS (SELECT l_suppkey AS k, l_linenumber AS z, l_quantity AS y, l_partkey % 40 AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS pos FROM lineitem WHERE l_discount < 0.03 AND l_orderkey >= l_suppkey * 10),
s AS (SELECT *, sqrt((z - lag(z) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (x - lag(x) OVER w) ** 2) AS step FROM p WINDOW w AS (PARTITION BY k ORDER BY pos))
SELECT k AS source_id, count(*) AS points, round(sum(coalesce(step, 0)), 4) AS arclength, CAST(min(z) AS BIGINT) AS z_min FROM s GROUP BY 1 HAVING min(z) >= 1 AND max(z) < 8""",
)
def track_store(t):
    from ..operators.ragged import over

    p = t("lineitem").where("l_discount < 0.03 and l_orderkey >= l_suppkey * 10")
    pos = F.row_number().over(over("l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]))
    p = p.select(F.col("l_suppkey").alias("source_id"), pos.alias("pos"), F.col("l_linenumber").cast("double").alias("z"), F.col("l_quantity").alias("y"), (F.col("l_partkey") % 40).cast("double").alias("x"))
    path = _folder(t)
    files.write_tracks(p, path)
    return files.tracks_within(p.sparkSession, path, 1.0, 8.0).select("source_id", F.size("points").cast("long").alias("points"), F.round("arclength", 4).alias("arclength"), F.col("z_min").cast("long").alias("z_min"))


@query(
    "A07 A08 A23 F18",
    """SELECT event_type || '.json' AS file, user_id % 10 AS collection_id, 'c' || user_id % 10 AS name, count(*) AS points, round(sum(value), 4) AS z, count(*) FILTER (event_id % 3 > 0) AS wound FROM events GROUP BY ALL""",
)
def point_collection_files(t):
    e = t("events")
    point = F.struct(F.array(F.lit(1.0), F.lit(2.0), F.col("value")).alias("p"), F.when(F.col("event_id") % 3 > 0, F.col("event_id").cast("double")).alias("wind_a"))
    c = e.groupBy("event_type", (F.col("user_id") % 10).cast("string").alias("k")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("event_id").cast("string"), point))).alias("points"))
    c = c.groupBy("event_type").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct(F.concat(F.lit("c"), "k").alias("name"), "points")))).alias("collections"))
    path = _folder(t)
    # One row, so one file, for each kind of event: a document is a whole in this format.
    c.select("event_type", F.to_json(F.struct(F.lit("1").alias("vc_pointcollections_json_version"), "collections")).alias("value")).repartition("event_type").write.partitionBy("event_type").text(path)
    p = files.point_collections(e.sparkSession, f"{path}/*/*.txt")
    kind = F.regexp_extract("source_file", "event_type=([^/]*)", 1)
    return p.groupBy(F.concat(kind, F.lit(".json")).alias("file"), "collection_id", "name").agg(F.count("*").alias("points"), F.round(F.sum("z"), 4).alias("z"), F.count("winding").alias("wound"))


@query("A09", "SELECT 'u' || user_id AS name, event_type AS tag, count(*) AS points, round(sum(value) * 0.25, 4) AS z FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL")
def fibre_files(t):
    e = t("events").where("event_type in ('view', 'click')")
    f = e.groupBy("user_id", "event_type").agg(F.collect_list(F.array(F.lit(1.0), F.lit(2.0), F.col("value"))).alias("control_points"))
    doc = F.struct(F.lit("vc3d_fiber").alias("type"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), "control_points", F.struct(F.col("event_type").alias("automatic_tag")).alias("hv_classification"))
    path = _folder(t)
    # A file is an array of the fibres of 64 users: one for each fibre would be more files than rows of a task.
    of = f.select(doc.alias("doc"), F.floor(F.col("user_id") / 64).alias("users")).groupBy("users").agg(F.to_json(F.collect_list("doc")).alias("value"))
    of.repartition("users").write.partitionBy("users").text(path)
    p = files.fibres(e.sparkSession, f"{path}/*/*.txt")
    return p.groupBy("name", "tag").agg(F.count("*").alias("points"), F.round(F.sum("z"), 4).alias("z"))


@query("A13", "SELECT CAST(s_suppkey AS DOUBLE) AS z, s_acctbal AS y, CAST(s_nationkey AS DOUBLE) AS x FROM supplier")
def axis_files(t):
    s = t("supplier")
    path = _folder(t)
    s.orderBy("s_suppkey").select(F.concat_ws(", ", F.col("s_suppkey").cast("string"), F.col("s_acctbal").cast("string"), F.col("s_nationkey").cast("string")).alias("value")).write.text(path)
    return files.axis_points(s.sparkSession, path)


_SURFACES = "v AS (SELECT l_returnflag AS s, l_suppkey AS i, l_linenumber AS j, max(l_quantity) AS z FROM lineitem WHERE l_tax < 0.07 GROUP BY 1, 2, 3)"


@query(
    "A10 A12 A20 B03 B14 B19 B20 C11",
    f"""WITH {_SURFACES}, m AS (SELECT s, min(i) AS i0, min(j) AS j0, max(i) AS i1, max(j) AS j1, count(*) AS vertices, sum(z) AS total FROM v GROUP BY 1),
q AS (SELECT a.s, count(*) AS quads FROM v a JOIN v b ON b.s = a.s AND b.i = a.i + 1 AND b.j = a.j JOIN v c ON c.s = a.s AND c.i = a.i AND c.j = a.j + 1 JOIN v d ON d.s = a.s AND d.i = a.i + 1 AND d.j = a.j + 1 GROUP BY 1)
SELECT s AS surface, vertices, round(total, 4) AS total, quads, CAST(quads * 400 AS DOUBLE) AS area, i1 - i0 + 1 AS rows, CAST(j1 - j0 + 1 AS BIGINT) AS columns, CAST(quads * 400 AS DOUBLE) AS listed_area FROM m JOIN q USING (s)""",
)
def surface_folders(t):
    v = t("lineitem").where("l_tax < 0.07").groupBy(F.col("l_returnflag").alias("surface"), F.col("l_suppkey").alias("i"), F.col("l_linenumber").alias("j")).agg(F.max("l_quantity").alias("z"))
    v = v.select("surface", "i", "j", "z", (F.col("i") * 4.0).alias("y"), (F.col("j") * 5.0).alias("x"))
    path, spark = _folder(t), v.sparkSession
    done = images.write_surfaces(v, path, 20.0, 7.91, "made", {"parent": "lineitem"})
    back = images.surfaces(spark, path).groupBy("surface").agg(F.count("*").alias("vertices"), F.round(F.sum("z"), 4).alias("total"))
    listed = files.surface_index(spark, path).select(F.col("name").alias("surface"), F.col("area").alias("listed_area"))
    return back.join(done, "surface").join(listed, "surface").select("surface", "vertices", "total", "quads", "area", "rows", "columns", "listed_area")


@query("A04 B02 G41", "SELECT true AS current, false AS after_more, count(*) > 0 AS files_named FROM region")
def stale_stores(t):
    path = _folder(t)
    spark = t("region").sparkSession
    t("nation").write.parquet(path)
    manifest = graph.cut_lineage(files.fingerprints(spark.read.parquet(path)))
    first = files.is_current(spark.read.parquet(path), manifest)
    t("nation").write.mode("append").parquet(path)
    after = files.is_current(spark.read.parquet(path), manifest)
    return spark.createDataFrame([(first, after, not manifest.isEmpty())], "current boolean, after_more boolean, files_named boolean")


@query("B10", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1")
def flat_metric_files(t):
    m = t("lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"), F.collect_set("l_linestatus").alias("nested"))
    path = _folder(t)
    files.write_flat_metrics(m, path)
    return m.sparkSession.read.schema("l_returnflag string, n bigint, total double").option("header", True).csv(f"{path}/csv")


@query("B05 B14", f"WITH {_SURFACES}, v2 AS (SELECT * FROM v WHERE s = 'A') SELECT 'f' AS kind, count(*) AS n FROM v2 a JOIN v2 b ON b.i = a.i + 1 AND b.j = a.j JOIN v2 c ON c.i = a.i AND c.j = a.j + 1 JOIN v2 d ON d.i = a.i + 1 AND d.j = a.j + 1 UNION ALL SELECT 'v', count(*) FROM v2")
def mesh_files(t):
    v = t("lineitem").where("l_tax < 0.07 and l_returnflag = 'A'").groupBy(F.col("l_suppkey").alias("i"), F.col("l_linenumber").alias("j")).agg(F.max("l_quantity").alias("z"))
    v = v.select("i", "j", F.col("j").cast("double").alias("x"), F.col("i").cast("double").alias("y"), "z")
    path = _folder(t)
    files.write_mesh(v, raster.valid_quads(v, "i", "j", []), path)
    return v.sparkSession.read.text(path).groupBy(F.substring("value", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


@query("B11 B13", "SELECT count(*) AS rows, sum(n_regionkey) AS total FROM nation")
def report_and_vote_files(t):
    path = _folder(t)
    spark = t("nation").sparkSession
    files.write_report(t("nation"), f"{path}/report", "Nations", 1000)
    rows = spark.read.text(f"{path}/report", wholetext=True).select((F.regexp_count("value", F.lit("<tr>")) - 1).cast("long").alias("rows"))
    t("nation").orderBy("n_nationkey").write.json(f"{path}/votes")
    return rows.join(spark.read.json(f"{path}/votes").agg(F.sum("n_regionkey").alias("total")))


@query("B06 T09", "SELECT l_linenumber AS part, count(*) AS n FROM lineitem GROUP BY 1")
def resumed_partitions(t):
    line = t("lineitem").select(F.col("l_linenumber").alias("part"), "l_partkey")
    path = _folder(t)
    files.write_new_partitions(line.where("part <= 3"), path, "part")
    files.write_new_partitions(line, path, "part")
    return line.sparkSession.read.parquet(path).groupBy("part").agg(F.count("*").alias("n"))


@query("A06 A02", "SELECT row_number() OVER (ORDER BY r_name) - 1 AS ordinal, r_name AS key, CAST(r_regionkey AS VARCHAR) AS value FROM region")
def key_value_store(t):
    import os
    import sqlite3

    # A store of five records, made here in the shared folder, which must be a mounted one: the tables have none.
    folder = _folder(t).removeprefix("file://")
    os.makedirs(folder)
    path = f"{folder}/store.sqlite"
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE Dict (key BLOB UNIQUE NOT NULL, value BLOB NOT NULL)")
        c.executemany("INSERT INTO Dict VALUES (?, ?)", [(r.r_name.encode(), str(r.r_regionkey).encode()) for r in t("region").collect()])
    d = images.dbm_records(t("region").sparkSession, path, 3)
    return d.select("ordinal", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query("A16 A28", "SELECT * FROM (VALUES ('nations', 'found'), ('regions', 'ambiguous'), ('notes', 'absent'), ('umbilicus', 'missing'), ('copied', 'true false')) v(key, status)")
def dataset_layout(t):
    path = _folder(t)
    spark = t("region").sparkSession
    for name in ("regions-a", "regions-b", "nations"):
        t("region").write.parquet(f"{path}/{name}")
    d = images.layout(spark, path, [("nations", "nations", True), ("notes", "notes", False), ("umbilicus", "umbilicus.json", True)], {"regions": "regions-*"})
    twice = [str(images.fetched(spark, f"{path}/nations", f"{path}/copy")).lower() for _ in range(2)]
    return d.select("key", "status").unionByName(spark.createDataFrame([("copied", " ".join(twice))], "key string, status string"))


_CELLS = "c AS (SELECT l_suppkey AS z, l_linenumber AS y, l_partkey % 30 AS x, CAST(max(l_quantity) AS INTEGER) AS v FROM lineitem GROUP BY 1, 2, 3)"


def _cells(t):
    return t("lineitem").groupBy(F.col("l_suppkey").alias("z"), F.col("l_linenumber").alias("y"), (F.col("l_partkey") % 30).alias("x")).agg(F.max("l_quantity").cast("int").alias("v"))


@query(
    "B07 B17 G29 R01",
    f"""WITH {_CELLS}, h AS (SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x, CAST(round_even(avg(v), 0) AS INTEGER) AS v FROM c GROUP BY 1, 2, 3), a AS (SELECT 0 AS level, * FROM c UNION ALL SELECT 1, * FROM h)
SELECT level, (z // 16) || '_' || (y // 16) || '_' || (x // 16) AS brick, CAST(sum(v) AS BIGINT) AS total, CAST(4096 AS BIGINT) AS cells, CAST(0 AS BIGINT) AS wrong FROM a WHERE v <> 0 GROUP BY 1, 2""",
)
def volume_pyramid(t):
    c = graph.cut_lineage(_cells(t))
    path, spark = _folder(t), c.sparkSession
    images.write_pyramid(c, path, ["z", "y", "x"], "v", 2, 16)
    wrong = images.wrong_bricks(images.bricks(c, ["z", "y", "x"], "v", 16), c, ["z", "y", "x"], "v", 16, 3, "23").agg(F.count("*").alias("wrong"))
    total = F.aggregate("data", F.lit(0).cast("long"), lambda s, x: s + x)
    level = lambda k: spark.read.parquet(f"{path}/{k}").select(F.lit(k).alias("level"), "brick", total.cast("long").alias("total"), F.size("data").cast("long").alias("cells"))
    return level(0).unionByName(level(1)).join(F.broadcast(wrong))  # wrong is one row


_LOSS = """s AS (SELECT event_type AS name, event_id % 300 AS z, value * cos(event_id * 0.7) AS y, value * sin(event_id * 0.7) AS x, user_id % 11 - 2 AS residual FROM events),
w AS (SELECT name, CAST(weight AS DOUBLE) AS weight FROM (VALUES ('view', 2), ('click', 0), ('error', -1), ('signup', 1)) v(name, weight)), k AS (SELECT CAST(range AS BIGINT) AS winding, CAST(range * 12 AS BIGINT) AS first, CAST(range * 12 + 12 AS BIGINT) AS fin FROM range(0, 20)),
t AS (SELECT name, greatest(residual, 0) AS residual, CAST(round_even((z - 10) / 5, 0) AS BIGINT) AS row, atan2(y, x) - floor(atan2(y, x) / (2 * pi())) * 2 * pi() AS theta, sqrt(y * y + x * x) AS radius FROM s),
u AS (SELECT *, CAST(round_even(greatest(0, radius - theta / (2 * pi()) * 10) / 10, 0) AS BIGINT) AS winding FROM t), p AS (SELECT u.*, first + least(CAST(floor(theta / (2 * pi()) * (fin - first)) AS BIGINT), fin - first - 1) AS col, first IS NOT NULL AND row BETWEEN 0 AND 49 AS inside FROM u LEFT JOIN k USING (winding)),
q AS (SELECT *, inside AND (row + col) % 9 > 0 AS shown FROM p), m AS (SELECT name, row, col, avg(residual) * abs(any_value(weight)) AS value FROM q JOIN w USING (name) WHERE shown AND weight <> 0 GROUP BY ALL)"""


def _loss(t):
    e = t("events")
    at = (F.col("event_id") * F.lit("0.7").cast("decimal(2,1)")).cast("double")  # exact before it is rounded, as in the SQL
    s = e.select(F.col("event_type").alias("name"), (F.col("event_id") % 300).cast("double").alias("z"), (F.col("value") * F.cos(at)).alias("y"), (F.col("value") * F.sin(at)).alias("x"), (F.col("user_id") % 11 - 2).cast("double").alias("residual"))
    spark = e.sparkSession
    weights = spark.createDataFrame([("view", 2.0), ("click", 0.0), ("error", -1.0), ("signup", 1.0)], "name string, weight double")
    windings = spark.range(20).select(F.col("id").alias("winding"), (F.col("id") * 12).alias("first"), (F.col("id") * 12 + 12).alias("end"))
    pixels = spark.range(50).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(239).cast("long"))).alias("col")).where("(row + col) % 9 > 0")
    return lossmaps.projected(s, windings, pixels, 10.0, 5.0, 10.0, 50), weights, pixels


@query(
    "B12 G20",
    f"""WITH {_LOSS}, n AS (SELECT name, count(*) FILTER (shown) AS sample_count, count(*) AS eligible, count(*) FILTER (inside) AS projected, count(*) FILTER (inside AND NOT shown) AS off_surface, count(*) FILTER (NOT inside) AS omitted FROM q GROUP BY 1),
v AS (SELECT name, count(*) AS pixels, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, max(value) AS maximum, quantile_cont(value, 0.95) FILTER (value > 0) AS display FROM m GROUP BY 1)
SELECT name, weight, sample_count, eligible, projected, off_surface, omitted, coalesce(pixels, 0) AS pixels, round(coalesce(p50, 0), 6) AS p50, round(coalesce(p95, 0), 6) AS p95, round(coalesce(maximum, 0), 6) AS maximum, round(coalesce(display, maximum, 0), 6) AS display FROM n JOIN w USING (name) LEFT JOIN v USING (name) WHERE weight <> 0""",
)
def loss_map_entries(t):
    p, weights, _ = _loss(t)
    e = lossmaps.entries(p, weights)
    return e.select(*[F.round(c, 6).alias(c) if c in ("p50", "p95", "maximum", "display") else c for c in e.columns])


@query("B12 G06", f"WITH {_LOSS}, d AS (SELECT DISTINCT a.name, a.row + x AS row, a.col + y AS col FROM m a, (VALUES (-1), (0), (1)) i(x), (VALUES (-1), (0), (1)) j(y)) SELECT name, count(*) AS coloured FROM d WHERE row BETWEEN 0 AND 49 AND col BETWEEN 0 AND 239 AND (row + col) % 9 > 0 GROUP BY 1")
def loss_map_pixels(t):
    p, weights, pixels = _loss(t)
    c = lossmaps.coloured(lossmaps.maps(p, weights), lossmaps.entries(p, weights), pixels)
    return c.where("a between 0 and 235 and least(r, g, b) >= 0 and greatest(r, g, b) <= 255").groupBy("name").agg(F.count("*").alias("coloured"))


@query(
    "J32 J15",
    """WITH k AS (SELECT l_suppkey AS c, l_linenumber AS z, avg(l_quantity) AS x FROM lineitem GROUP BY 1, 2), l AS (SELECT unnest([1.5, 2.25, 4.75]) AS lev), s AS (SELECT s_suppkey AS c, CAST(lev AS DOUBLE) AS lev FROM supplier, l)
SELECT s.c AS curve, s.lev AS z, round(a.x + (s.lev - a.z) / (b.z - a.z) * (b.x - a.x), 6) AS x FROM s JOIN k a ON a.c = s.c AND a.z = (SELECT max(z) FROM k WHERE k.c = s.c AND k.z <= s.lev) JOIN k b ON b.c = s.c AND b.z = (SELECT min(z) FROM k WHERE k.c = s.c AND k.z >= s.lev)""",
)
def curves_at_levels(t):
    knots = t("lineitem").groupBy(F.col("l_suppkey").alias("curve"), F.col("l_linenumber").cast("double").alias("kz")).agg(F.avg("l_quantity").alias("x"))
    asked = t("supplier").select(F.col("s_suppkey").alias("curve"), F.explode(F.array(*[F.lit(v) for v in (1.5, 2.25, 4.75)])).alias("z"))
    b = joins.bracketed(asked, knots, "curve", "z", "kz", "x")
    return b.where("x is not null").select("curve", "z", F.round("x", 6).alias("x"))


_IMAGE = "g AS (SELECT l_suppkey AS i, l_linenumber AS j, avg(l_quantity) AS r, avg(l_tax) AS gr, avg(l_discount) AS b, max(l_quantity) AS a FROM lineitem GROUP BY 1, 2)"


@query(
    "R05 R06",
    f"""WITH {_IMAGE}, p AS (SELECT event_id, user_id % 90 + (event_id % 4) / 4 AS i, 1 + event_id % 24 / 4 AS j FROM events), q AS (SELECT *, unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS e FROM p),
w AS (SELECT *, (CASE WHEN a = 1 THEN i - floor(i) ELSE 1 - (i - floor(i)) END) * (CASE WHEN e = 1 THEN j - floor(j) ELSE 1 - (j - floor(j)) END) AS w FROM q)
SELECT event_id, round(CASE WHEN count(g.r) = count(*) THEN sum(w * r) END, 6) AS r, round(CASE WHEN count(g.r) = count(*) THEN sum(w * gr) END, 6) AS g, round(CASE WHEN count(g.r) = count(*) THEN sum(w * b) END, 6) AS b, round(CASE WHEN count(g.r) = count(*) THEN sum(w * g.a) END, 6) AS a
FROM w LEFT JOIN g ON g.i = floor(w.i) + w.a AND g.j = floor(w.j) + e WHERE w > 0 GROUP BY 1""",
)
def warped_image(t):
    img = t("lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_linenumber").alias("j")).agg(F.avg("l_quantity").alias("r"), F.avg("l_tax").alias("g"), F.avg("l_discount").alias("b"), F.max("l_quantity").alias("a"))
    p = t("events").select("event_id", (F.col("user_id") % 90 + (F.col("event_id") % 4) / 4).alias("i"), (1 + F.col("event_id") % 24 / 4).alias("j"))
    w = raster.warped(p, img, "i", "j", ["r", "g", "b", "a"])
    return w.select("event_id", *[F.round(c, 6).alias(c) for c in "rgba"])


@query(
    "R07",
    """WITH v AS (SELECT l_linenumber AS j, l_suppkey AS i, l_suppkey * 4.0 + avg(l_quantity) / 20 AS y, l_linenumber * 5.0 AS x FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2),
q AS (SELECT a.i, a.j, a.y AS y00, a.x AS x00, b.y AS y01, b.x AS x01, c.y AS y10, c.x AS x10, d.y AS y11, d.x AS x11 FROM v a JOIN v b ON b.i = a.i AND b.j = a.j + 1 JOIN v c ON c.i = a.i + 1 AND c.j = a.j JOIN v d ON d.i = a.i + 1 AND d.j = a.j + 1),
f AS (SELECT y10 AS a_y, x10 AS a_x, y00 AS b_y, x00 AS b_x, y01 AS c_y, x01 AS c_x FROM q UNION ALL SELECT y10, x10, y01, x01, y11, x11 FROM q),
p AS (SELECT *, unnest(generate_series(CAST(ceil(least(a_y, b_y, c_y)) AS BIGINT), CAST(floor(greatest(a_y, b_y, c_y)) AS BIGINT))) AS py FROM f), r AS (SELECT *, unnest(generate_series(CAST(ceil(least(a_x, b_x, c_x)) AS BIGINT), CAST(floor(greatest(a_x, b_x, c_x)) AS BIGINT))) AS px FROM p),
e AS (SELECT py, px, (b_x - a_x) * (py - a_y) - (b_y - a_y) * (px - a_x) AS u, (c_x - b_x) * (py - b_y) - (c_y - b_y) * (px - b_x) AS v, (a_x - c_x) * (py - c_y) - (a_y - c_y) * (px - c_x) AS w FROM r)
SELECT py AS y, px AS x, count(*) AS faces FROM e WHERE least(u, v, w) >= 0 OR greatest(u, v, w) <= 0 GROUP BY 1, 2""",
)
def rasterised_triangles(t):
    v = t("lineitem").where("l_returnflag = 'N'").groupBy(F.col("l_suppkey").alias("i"), F.col("l_linenumber").alias("j")).agg(F.avg("l_quantity").alias("q"))
    v = v.select("i", "j", F.lit(0.0).alias("z"), (F.col("i") * 4.0 + F.col("q") / 20).alias("y"), (F.col("j") * 5.0).alias("x"))
    return raster.covered(surfaces.triangles(v, [], "i", "j", list("zyx")))


@query("G41", "WITH r AS (SELECT l_partkey AS k, min(l_orderkey) AS first FROM lineitem GROUP BY 1) SELECT l_suppkey, count(*) FILTER (l_orderkey > first) AS hits, count(*) FILTER (l_orderkey = first) AS misses, round(count(*) FILTER (l_orderkey > first) / count(*), 6) AS rate FROM lineitem JOIN r ON l_partkey = k GROUP BY 1")
def hit_rates(t):
    line = t("lineitem").select("l_suppkey", "l_partkey", "l_orderkey")
    first = line.groupBy(F.col("l_partkey").alias("k")).agg(F.min("l_orderkey").alias("first"))
    hit = F.col("l_orderkey") > F.col("first")
    j = line.join(first, F.col("l_partkey") == F.col("k")).groupBy("l_suppkey")
    return j.agg(F.count(F.when(hit, 1)).alias("hits"), F.count(F.when(~hit, 1)).alias("misses"), F.round(expr.guarded_ratio(F.sum(hit.cast("int")), F.count("*")), 6).alias("rate"))


@query("A15", "SELECT * FROM (VALUES ('bad', 'corrupt'), ('half', 'missing: data.pkl'), ('old', 'legacy')) v(name, problem)")
def saved_states(t):
    import io
    import os
    import zipfile

    folder = _folder(t).removeprefix("file://")
    os.makedirs(folder)

    def archive(*names: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, n * 50)
        return out.getvalue()

    whole = archive("state/data.pkl", "state/version")
    contents = {"whole": whole, "bad": whole.replace(b"data.pklstate", b"data.pkl_____", 1), "half": archive("state/version"), "old": b"\x80\x02}q\x00."}
    for name, content in contents.items():
        with open(f"{folder}/{name}.ckpt", "wb") as f:
            f.write(content)
    p = images.container_problems(t("region").sparkSession, [f"{folder}/{n}.ckpt" for n in contents], ["data.pkl", "version"])
    return p.select(F.regexp_extract("path", "([a-z]+)[.]ckpt$", 1).alias("name"), "problem")


@query(
    "A14 A24 B06 T09",
    """WITH c AS (SELECT l_suppkey AS z, l_linenumber AS y, l_partkey % 50 AS x, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3) SELECT z // 32 AS slab, count(*) AS voxels, CAST(sum(v) AS DOUBLE) AS total FROM c WHERE z >= 3 AND y BETWEEN 2 AND 5 AND x < 40 GROUP BY 1""",
)
def volume_files(t):
    from ..sources import zarr

    c = t("lineitem").groupBy(F.col("l_suppkey").alias("z"), F.col("l_linenumber").alias("y"), (F.col("l_partkey") % 50).alias("x")).agg(F.max("l_quantity").cast("int").alias("value"))
    path, top = _folder(t), c.agg(F.max("z")).first()[0] + 1
    shape = (top, 8, 50)
    # A run that ends after some chunks, and one that goes on.
    zarr.write_volume(c.where("z < 32"), path, shape, 32)
    zarr.write_volume(c, path, shape, 32)
    v = zarr.voxels(c.sparkSession, path, (3, 2, 0), (top, 6, 40))
    return v.groupBy(F.floor(F.col("z") / 32).alias("slab")).agg(F.count("*").alias("voxels"), F.sum("value").alias("total"))


@query("T12 T13 T14 T03", "SELECT CAST(e AS BIGINT) AS batches, CAST((SELECT count(*) FROM nation) AS BIGINT) AS rows, CAST((SELECT sum(n_nationkey) FROM nation) AS BIGINT) AS total, true AS in_order FROM (SELECT 5 AS e)")
def resumed_stream(t):
    from ..streaming import log

    path, n = _folder(t), t("nation")
    spark = n.sparkSession
    put = lambda k: n.where(F.col("n_nationkey") % 5 == k).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = lambda: spark.readStream.schema(n.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    for k in range(3):
        put(k)
    log.ended_batches(stream(), f"{path}/out", f"{path}/state")
    for k in (3, 4):
        put(k)
    # A new query with the same checkpoint: what was read is not read again; one file is in flight at a time, the oldest first.
    batches = log.ended_batches(stream(), f"{path}/out", f"{path}/state")
    out = spark.read.parquet(f"{path}/out")
    order = out.select("batch", (F.col("n_nationkey") % 5).alias("k")).distinct()
    return out.agg(F.lit(batches).cast("long").alias("batches"), F.count("*").alias("rows"), F.sum("n_nationkey").cast("long").alias("total")).join(order.agg(F.bool_and(F.col("batch") == F.col("k")).alias("in_order")))


@query(
    "J30",
    """WITH j AS (SELECT n_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1), f AS (SELECT r_regionkey AS k FROM region), g AS (SELECT n_nationkey AS k FROM nation)
SELECT s AS strategy, n_name, suppliers FROM j, (VALUES ('any'), ('broadcast'), ('merge'), ('hash'), ('loop')) v(s) UNION ALL SELECT 'right', CAST(g.k AS VARCHAR), count(f.k) FROM f RIGHT JOIN g USING (k) GROUP BY ALL""",
)
def join_strategies(t):
    n = t("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    out = None
    for name in joins.STRATEGIES:
        j = joins.joined(t("supplier"), n, ["s_nationkey"], strategy=name).groupBy("n_name").agg(F.count("*").alias("suppliers")).select(F.lit(name).alias("strategy"), "n_name", "suppliers")
        out = j if out is None else out.unionByName(j)
    r, k = t("region").select(F.col("r_regionkey").alias("k"), F.lit(1).alias("one")), t("nation").select(F.col("n_nationkey").alias("k"))
    right = joins.joined(r, k, ["k"], "right", "merge").groupBy(F.col("k").cast("string").alias("n_name")).agg(F.count("one").alias("suppliers"))
    return out.unionByName(right.select(F.lit("right").alias("strategy"), "n_name", "suppliers"))
