"""Logs, incremental state and documents with nested fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr
from ..operators import joins, ragged
from ..sources import files
from ..streaming import log
from .registry import query


@query("T01 W24", 'SELECT event_id, event_type, CAST(500 + 200 AS BIGINT) AS next_cursor, CAST(0 AS BIGINT) AS dropped, false AS cursor_reset FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 200')
def log_cursor_page(t):
    return log.page(t("events").select("event_id", "event_type"), "event_id", 500, 200)


@query(
    "T01 W24",
    """WITH m AS (SELECT greatest(min(event_id), max(event_id) - 4999) AS first FROM events), p AS (SELECT event_id, user_id, first FROM events, m WHERE event_id > greatest(100, first - 1) ORDER BY event_id LIMIT 50)
SELECT event_id, user_id, max(event_id) OVER () AS next_cursor, CAST(greatest(first - 101, 0) AS BIGINT) AS dropped, false AS cursor_reset FROM p""",
)
def log_ring_overrun(t):
    return log.page(t("events").select("event_id", "user_id"), "event_id", 100, 50, ring=5000)


@query("B15 W24 T11", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, event_id, CAST(rn AS BIGINT) AS rn FROM r WHERE rn <= 3")
def keep_latest_k(t):
    k = log.keep_latest(t("events"), "user_id", [F.desc("ts"), F.desc("event_id")], 3)
    return k.select("user_id", "event_id", F.col("rn").cast("long").alias("rn"))


@query("T02 W24", "SELECT user_id, event_type, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS slot, count(*) AS merged, max(event_id) AS event_id FROM events GROUP BY 1, 2, 3")
def coalesce_latest(t):
    return log.coalesced(t("events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts", "event_id", 21600).select("user_id", "event_type", "slot", "merged", "event_id")


@query(
    "T02 T03",
    """WITH m AS (SELECT floor((epoch(max(ts)) - 3600) / 21600) AS open FROM events)
SELECT user_id, event_type, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS slot, count(*) AS merged, max(event_id) AS event_id FROM events, m WHERE floor(epoch(ts) / 21600) < open GROUP BY 1, 2, 3""",
)
def coalesced_stream(t):
    """All events, as a stream in two runs from one checkpoint: what the watermark has passed by then."""
    from ..streaming import ring
    from .stores import _folder

    path, spark = _folder(t), t("events").sparkSession
    at = F.timestamp_micros(F.round(expr.seconds("ts") * 1_000_000).cast("bigint"))
    e = t("events").where("ts is not null").select(F.concat_ws(":", "user_id", "event_type").alias("key"), at.alias("at"), "event_id", "user_id", "event_type")
    ends = e.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).first()
    early = F.lit(False) if ends["lo"] is None else F.col("at") < F.lit(ends["lo"] + (ends["hi"] - ends["lo"]) / 2)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ring.PROVIDER)
    try:
        for part in (early, ~early):
            e.where(part).write.mode("append").parquet(f"{path}/in")
            stream = spark.readStream.schema(e.schema).parquet(f"{path}/in")
            out = ring.coalesced_stream(stream, "key", "at", "event_id", 21600, "1 hour")
            out.writeStream.option("checkpointLocation", f"{path}/state").format("parquet").option("path", f"{path}/out").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(out.schema).parquet(f"{path}/out").select("user_id", "event_type", "slot", "merged", "event_id")


@query("T06", "SELECT user_id * 10 + event_id % 10 AS command, min(event_id) AS event_id, count(*) - 1 AS repeats FROM events GROUP BY 1")
def command_dedup(t):
    e = t("events").select((F.col("user_id") * 10 + F.col("event_id") % 10).alias("command"), "event_id")
    return log.first_commands(e.withColumn("seq", F.col("event_id")), "command", "seq").select("command", "event_id", "repeats")


@query("T09 T03 U05 A18", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def resume_done_set(t):
    done = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return log.remaining(t("orders").select("o_orderkey"), done, "o_orderkey")


@query(
    "T05 T04",
    """WITH k AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'committed' WHEN 'click' THEN 'incorporated' ELSE 'seen' END AS kind FROM events),
s AS (SELECT user_id, max((kind = 'committed')::INT) AS c, max((kind = 'incorporated')::INT) AS i, max(event_id) AS last FROM k GROUP BY 1)
SELECT user_id, CASE WHEN i = 1 THEN 'incorporated' ELSE 'pending' END AS state, c = 1 AND i = 1 AS settled, last FROM s""",
)
def projected_states(t):
    kind = F.when(F.col("event_type") == "purchase", "committed").when(F.col("event_type") == "click", "incorporated").otherwise("seen")
    return log.projected_states(t("events").select("user_id", "event_id", kind.alias("kind")), "user_id", "event_id")


@query(
    "G48 B21",
    """WITH g AS (SELECT l_orderkey AS k, count(DISTINCT l_linenumber) AS reported, count(DISTINCT l_returnflag) AS epochs, count(DISTINCT l_linestatus) AS states, arg_min(l_linenumber, (l_returnflag, l_linenumber)) AS lag FROM lineitem GROUP BY 1)
SELECT k, reported, reported = 3 AND epochs = 1 AND states = 1 AS ready, CASE WHEN NOT (reported = 3 AND epochs = 1 AND states = 1) THEN lag END AS laggard FROM g""",
)
def collective_state(t):
    c = log.collective_state(t("lineitem").withColumnRenamed("l_orderkey", "k"), "k", "l_linenumber", "l_returnflag", "l_linestatus", 3)
    return c.select("k", "reported", "ready", "laggard")


@query("A07 A23 F18 F20 M7", "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n, count(json_extract(props, '$.none')) AS missing FROM events GROUP BY 1, 2")
def props_json_explode(t):
    p = t("events").withColumn("m", F.from_json("props", "map<string,bigint>")).select("event_type", F.explode("m").alias("key", "v")).where("key = 'k'")
    return p.groupBy("event_type", (F.col("v") % 10).alias("k")).agg(F.count("*").alias("n"), F.count(F.when(F.col("key") == "none", 1)).alias("missing"))


@query(
    "A25 A17",
    """WITH m AS (SELECT max(o_orderkey) + 1 AS top FROM orders), j AS (SELECT CAST(unnest(generate_series(0, top - 1, 700)) AS BIGINT) AS lo, top FROM m)
SELECT lo, least(lo + 1000, top) AS hi, count(o_orderkey) AS n FROM j LEFT JOIN orders ON o_orderkey >= lo AND o_orderkey < least(lo + 1000, top) GROUP BY 1, 2""",
)
def slab_jobs(t):
    top = t("orders").agg(F.max("o_orderkey")).first()[0]
    jobs = files.slab_jobs(t("region").sparkSession, 0, 0 if top is None else top + 1, 700, 1000)
    hit = joins.range_pairs(t("orders").select("o_orderkey"), jobs, "o_orderkey", "lo", "hi", 1000.0).groupBy("lo", "hi").agg(F.count("*").alias("n"))
    return jobs.join(hit, ["lo", "hi"], "left").select("lo", "hi", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("A29 U02", "WITH a AS (SELECT c_custkey AS id, c_name AS name FROM customer), m AS (SELECT max(id) AS top FROM a), b AS (SELECT top + row_number() OVER (ORDER BY s_suppkey) AS id, s_name AS name FROM supplier, m) SELECT * FROM a UNION ALL SELECT * FROM b")
def union_reassigned_ids(t):
    a, b = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return files.appended_with_new_ids(a, b, "id")


@query("U01 U03", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).unionByName(t("supplier").select(F.col("s_nationkey").alias("k"))).distinct()


@query("extension: windows of event time", "SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour_slot, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(t):
    slot = F.floor(expr.seconds("ts") / 3600).alias("hour_slot")
    return t("events").groupBy(slot, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "W22",
    """WITH p AS (SELECT l_suppkey AS k, l_partkey % 400 AS x, count(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT k, x, avg(n) OVER (PARTITION BY k ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM p),
a AS (SELECT k, avg(n) AS mean FROM p GROUP BY 1), h AS (SELECT k, x, m > mean AS hit FROM s JOIN a USING (k)),
r AS (SELECT k, x, hit, row_number() OVER (PARTITION BY k ORDER BY x) - 1 AS spot, row_number() OVER (PARTITION BY k ORDER BY x) - sum(hit::INT) OVER (PARTITION BY k ORDER BY x ROWS UNBOUNDED PRECEDING) AS g FROM h)
SELECT k, min(spot) AS first_at, max(spot) AS last_at, count(*) AS length FROM r WHERE hit GROUP BY k, g HAVING count(*) >= 4""",
)
def profile_runs(t):
    p = t("lineitem").groupBy(F.col("l_suppkey").alias("k"), (F.col("l_partkey") % 400).alias("x")).agg(F.count("*").alias("n"))
    mean = p.groupBy("k").agg(F.avg("n").alias("mean"))
    p = p.withColumn("m", F.avg("n").over(ragged.over("k", "x").rowsBetween(-2, 2))).join(mean, "k")
    i = ragged.islands(p, "k", "x", F.col("m") > F.col("mean")).where("length >= 4")
    return i.select("k", F.col("start").cast("long").alias("first_at"), F.col("end").cast("long").alias("last_at"), "length")


@query("W23", None)
def line_gaps(t):
    from ..operators import raster

    c = t("lineitem").groupBy((F.col("l_partkey") % 160).alias("i"), F.col("l_suppkey").alias("j")).agg(F.sum(F.when(F.col("l_partkey") % 16 < 5, F.col("l_quantity")).otherwise(0.0)).alias("v"))
    g = raster.line_gaps(c, "i", "j", "v", 160, 16, 8, (12.0, 20.0), 0.01)
    return g.select("start", F.concat_ws(",", F.transform("gaps", lambda x: x.cast("string"))).alias("gaps"), F.round("score", 6).alias("score"))
