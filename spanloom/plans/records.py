"""Checks, manifests, labels and orders of records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import ragged
from ..streaming import log
from .registry import query


@query(
    "C07 G07 M14",
    """WITH b AS (SELECT hour(ts) AS h, avg(value) AS mean FROM events GROUP BY 1), e AS (SELECT user_id, hour(ts) AS h, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS z FROM events)
SELECT user_id, bool_or(value <= mean) AS inside FROM e JOIN b ON e.h = b.h WHERE a = 1 OR z = 1 GROUP BY 1""",
)
def endpoints_in_envelope(t):
    e = t("events").select("user_id", "ts", "event_id", F.hour("ts").alias("h"), "value")
    envelope = e.groupBy("h").agg(F.avg("value").alias("mean"))
    place, point = F.struct("ts", "event_id"), F.struct("h", "value")
    ends = e.groupBy("user_id").agg(F.array(F.min_by(point, place), F.max_by(point, place)).alias("ends")).select("user_id", F.explode("ends").alias("p")).select("user_id", "p.*")
    return ends.join(envelope, "h").groupBy("user_id").agg(F.bool_or(F.col("value") <= F.col("mean")).alias("inside"))


@query(
    "C19 C20 C25 C26 C27 C28",
    """SELECT o_orderkey, concat_ws('; ', CASE WHEN NOT o_totalprice > 1000 THEN 'price: too low' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status: not final' END, CASE WHEN o_custkey % 3 = 0 AND o_orderpriority LIKE '1%' THEN 'customer: not served' END) AS failures
FROM orders WHERE NOT o_totalprice > 1000 OR o_orderstatus NOT IN ('F', 'O') OR o_custkey % 3 = 0 AND o_orderpriority LIKE '1%'""",
)
def request_validation(t):
    rules = [("price: too low", ~(F.col("o_totalprice") > 1000)), ("status: not final", ~F.col("o_orderstatus").isin("F", "O")), ("customer: not served", (F.col("o_custkey") % 3 == 0) & F.col("o_orderpriority").startswith("1"))]
    found = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]), lambda x: x.isNotNull())
    return t("orders").select("o_orderkey", found.alias("f")).where(F.size("f") > 0).select("o_orderkey", F.array_join("f", "; ").alias("failures"))


@query("G40", "SELECT CASE WHEN l_quantity < 5 THEN 'few' WHEN l_discount > 0.08 THEN 'cheap' WHEN l_tax = 0 THEN 'untaxed' ELSE 'none' END AS reason, count(*) AS n FROM lineitem GROUP BY 1")
def failure_reasons(t):
    reason = F.when(F.col("l_quantity") < 5, "few").when(F.col("l_discount") > 0.08, "cheap").when(F.col("l_tax") == 0, "untaxed").otherwise("none")
    return t("lineitem").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("W13", "SELECT o_orderkey, min(o_totalprice) OVER w AS low, arg_min(o_orderkey, o_totalprice) OVER w AS low_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
def prefix_minima(t):
    w = ragged.running(ragged.over("o_custkey", ["o_orderdate", "o_orderkey"]))
    return t("orders").select("o_orderkey", F.min("o_totalprice").over(w).alias("low"), F.min(F.struct("o_totalprice", "o_orderkey")).over(w)["o_orderkey"].alias("low_key"))


@query(
    "S25 A14",
    """WITH l AS (SELECT unnest([1.0, 2.0, 4.0, 8.0, 16.0]) AS scale), j AS (SELECT s_suppkey, scale, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(ln((1 + s_suppkey % 23) / scale)), scale) AS rn FROM supplier, l) SELECT s_suppkey, CAST(scale AS DOUBLE) AS scale FROM j WHERE rn = 1""",
)
def nearest_scale(t):
    scales = F.array(*[F.lit(v) for v in (1.0, 2.0, 4.0, 8.0, 16.0)])
    far = F.transform(scales, lambda s: F.struct(F.abs(F.log((1 + F.col("s_suppkey") % 23) / s)).alias("d"), s.alias("s")))
    return t("supplier").select("s_suppkey", F.array_min(far)["s"].alias("scale"))


@query("W29 F01", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_acctbal % 6.25 + 6.25) % 6.25, c_custkey) AS place FROM customer")
def phase_order(t):
    # pmod leaves out the sum where nothing is below 0, and thereby its rounding, which makes ties.
    phase = (F.col("c_acctbal") % 6.25 + 6.25) % 6.25
    c = ragged.numbered_within(t("customer").select("c_nationkey", "c_custkey", phase.alias("phase")), ["c_nationkey"], ["phase", "c_custkey"], "place")
    return c.select("c_custkey", (F.col("place") + 1).cast("long").alias("place"))


@query("A19 F16", "SELECT c_custkey, CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS INTEGER) AS suffix, regexp_replace(c_name, '[^A-Za-z0-9]+', '_', 'g') AS safe FROM customer")
def numeric_suffixes(t):
    return t("customer").select("c_custkey", expr.numeric_suffix("c_name").alias("suffix"), F.regexp_replace("c_name", "[^A-Za-z0-9]+", "_").alias("safe"))


@query("F25 T11", "SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) // 60 || ':' || lpad(CAST(CAST(sum(l_quantity) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS lasted FROM lineitem GROUP BY 1")
def duration_labels(t):
    s = t("lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("s"))
    return s.select("l_partkey", F.concat(F.expr("s div 60").cast("string"), F.lit(":"), F.lpad((F.col("s") % 60).cast("string"), 2, "0")).alias("lasted"))


@query(
    "S23 M21 A22",
    """WITH r AS (SELECT l_orderkey AS ray, l_linenumber AS level, min(l_extendedprice) AS at FROM lineitem GROUP BY 1, 2)
SELECT a.ray AS ray, a.level AS a, b.level AS b, round(b.at - a.at, 4) AS gap FROM r a JOIN r b ON a.ray = b.ray AND b.level - a.level BETWEEN 1 AND 3""",
)
def ray_pairs(t):
    r = t("lineitem").groupBy(F.col("l_orderkey").alias("ray"), F.col("l_linenumber").alias("level")).agg(F.min("l_extendedprice").alias("at"))
    a, b = r.select("ray", F.col("level").alias("a"), F.col("at").alias("x")), r.select("ray", F.col("level").alias("b"), F.col("at").alias("y"))
    return a.join(b, "ray").where((F.col("b") - F.col("a")).between(1, 3)).select("ray", "a", "b", F.round(F.col("y") - F.col("x"), 4).alias("gap"))


@query(
    "B15 M22 B04",
    """WITH r AS (SELECT o_orderstatus AS kind, o_orderkey AS artifact, sha256(o_orderkey || ':' || o_orderpriority) AS digest, row_number() OVER (PARTITION BY o_orderstatus, o_custkey % 5 ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) SELECT kind, artifact, digest FROM r WHERE rn <= 2""",
)
def newest_artifacts(t):
    o = t("orders").withColumn("kind", F.col("o_orderstatus")).withColumn("session", F.col("o_custkey") % 5)
    k = log.keep_latest(o, ["kind", "session"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 2)
    return k.select("kind", F.col("o_orderkey").alias("artifact"), F.sha2(F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderpriority"), 256).alias("digest"))


@query(
    "C22 F13 W08",
    """WITH s AS (SELECT o_orderkey, o_totalprice, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS so_far, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS whole FROM orders)
SELECT o_orderkey, round(so_far / whole, 8) AS progress FROM s WHERE so_far <= 0.5 * whole""",
)
def progressive_mask(t):
    w = ragged.over("o_custkey", ["o_orderdate", "o_orderkey"])
    s = t("orders").select("o_orderkey", F.sum("o_totalprice").over(ragged.running(w)).alias("so_far"), F.sum("o_totalprice").over(Window.partitionBy("o_custkey")).alias("whole"))
    return s.where("so_far <= 0.5 * whole").select("o_orderkey", F.round(F.col("so_far") / F.col("whole"), 8).alias("progress"))


@query(
    "extension: sessions of event time",
    """WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 3600 OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS n FROM events),
s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS first_ts, count(*) AS events FROM s GROUP BY user_id, s""",
)
def session_windows(t):
    s = t("events").groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"))
    return s.select("user_id", "first_ts", "events")


@query(
    "G18 G19 S17 S03",
    """WITH r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, min(n) AS documents, min(doc_id) AS first_seen, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS first_three FROM r WHERE rn <= 3 GROUP BY 1""",
)
def source_groups(t):
    d = t("documents").select("source", "doc_id")
    size = d.groupBy("source").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_seen"))
    first = log.keep_latest(d, "source", [F.col("doc_id")], 3).groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("first_three"))
    return size.join(first, "source")


@query(
    "F19 F21 C21",
    """WITH o AS (SELECT o_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity, l_partkey) AS q, min(l_shipdate) AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
SELECT o_orderkey, CAST(len(q) AS BIGINT) AS n, list_max(q) AS top, CAST(list_position(q, list_max(q)) - 1 AS BIGINT) AS argmax, coalesce(list_sum(q[1:2]), 0) AS head, q[len(q)] AS last, strftime(s, '%Y-%m-%dT%H:%M:%S') AS stamp FROM o""",
)
def array_and_time_functions(t):
    o = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_partkey"))).alias("a"), F.min("l_shipdate").alias("s"))
    o = o.join(t("orders").select("o_orderkey"), "o_orderkey", "left_semi").withColumn("q", F.transform("a", lambda x: x["l_quantity"]))
    top = F.array_max("q")
    return o.select(
        "o_orderkey", F.size("q").cast("long").alias("n"), top.alias("top"), (F.array_position("q", top) - 1).alias("argmax"),
        F.aggregate(F.slice("q", 1, 2), F.lit(0.0), lambda s, x: s + x).alias("head"), F.element_at("q", -1).alias("last"), F.date_format("s", "yyyy-MM-dd'T'HH:mm:ss").alias("stamp"),
    )


@query(
    "B18 C28 F20",
    """WITH m AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id FROM events) SELECT event_id, k AS renamed, user_id AS added, CASE WHEN k > 500 THEN 1 ELSE 0 END AS unknown FROM m""",
)
def migrated_settings(t):
    from ..sources.files import migrated_settings as migrate

    props = F.from_json("props", "map<string,bigint>")
    extra = F.map_concat(props, F.when(F.element_at(props, "k") > 500, F.create_map(F.lit("odd"), F.lit(1).cast("long"))).otherwise(F.create_map().cast("map<string,bigint>")))
    e = t("events").select("event_id", extra.alias("old"), F.create_map(F.lit("added"), "user_id").alias("defaults"))
    m = e.withColumn("new", migrate(F.col("old"), {"k": "renamed"}, ["renamed", "added"], F.col("defaults")))
    return m.select("event_id", F.element_at("new.settings", "renamed").alias("renamed"), F.element_at("new.settings", "added").alias("added"), F.size("new.unknown").alias("unknown"))
