"""Aggregates with stated ties and roundings, samples, and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr
from ..operators import aggs, joins, sampling
from .registry import query


@query(
    "G09 G10 F03",
    """WITH m AS (SELECT l_partkey, quantile_disc(l_discount * 100 + 0.3, 0.5) AS med FROM lineitem GROUP BY 1),
d AS (SELECT l.l_partkey, med, quantile_disc(abs((l_discount * 100 + 0.3) - floor((l_discount * 100 + 0.3) + 0.5)), 0.5) AS off FROM lineitem l JOIN m ON l.l_partkey = m.l_partkey GROUP BY 1, 2)
SELECT l_partkey, round(med, 6) AS median, round(off, 6) AS off, CAST(CASE WHEN off <= 0.25 THEN floor(med + 0.5) ELSE ceil(med) END AS BIGINT) AS target FROM d""",
)
def lower_median_snap(t):
    s = aggs.snapped(t("lineitem").select("l_partkey", (F.col("l_discount") * 100 + 0.3).alias("v")), "l_partkey", "v")
    return s.select("l_partkey", F.round("median", 6).alias("median"), F.round("off", 6).alias("off"), F.col("target").cast("long").alias("target"))


@query(
    "G11 G36",
    "WITH c AS (SELECT l_partkey, l_quantity AS q, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, q) AS rn FROM c) SELECT l_partkey, q, n FROM r WHERE rn = 1",
)
def mode_smallest_tie(t):
    return aggs.mode(t("lineitem").select("l_partkey", F.col("l_quantity").alias("q")), "l_partkey", "q")


@query("G12 G13 G15 G33", "SELECT l_suppkey, count(*) FILTER (l_discount <= 0.05) AS satisfied, count(*) AS total, round(count(*) FILTER (l_discount <= 0.05) / greatest(count(*), 1), 6) AS ratio FROM lineitem GROUP BY 1")
def satisfaction_counts(t):
    s = F.sum((F.col("l_discount") <= 0.05).cast("int"))
    return t("lineitem").groupBy("l_suppkey").agg(s.alias("satisfied"), F.count("*").alias("total"), F.round(s / F.greatest(F.count("*"), F.lit(1)), 6).alias("ratio"))


@query(
    "G14 G15 B09 G34",
    """WITH p AS (SELECT l_partkey, any_value(p_retailprice) AS area, count(*) AS n, count(*) FILTER (l_quantity BETWEEN 10 AND 40) AS ok FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT count(*) AS objects, count(*) FILTER (ok >= 0.6 * n) AS satisfied, round(sum(area * ok / n) / greatest(sum(area), 1e-9), 8) AS area_ratio, round(sum(CASE WHEN ok >= 0.6 * n THEN area ELSE 0 END) / greatest(sum(area), 1e-9), 8) AS whole_ratio FROM p""",
)
def area_weighted_satisfaction(t):
    p = t("lineitem").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey")
    ok = F.sum(F.col("l_quantity").between(10, 40).cast("int"))
    p = p.groupBy("l_partkey").agg(F.first("p_retailprice").alias("area"), F.count("*").alias("n"), ok.alias("ok"))
    hit = F.col("ok") >= 0.6 * F.col("n")
    return p.agg(F.count("*").alias("objects"), F.count(F.when(hit, 1)).alias("satisfied"), F.round(F.sum(F.col("area") * F.col("ok") / F.col("n")) / F.greatest(F.sum("area"), F.lit(1e-9)), 8).alias("area_ratio"), F.round(aggs.weighted_ratio(hit, "area"), 8).alias("whole_ratio"))


@query("G05 M14", "SELECT event_type, CAST(hour(ts) AS BIGINT) AS h, count(value) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def bin2d_mean(t):
    b = aggs.bin_means(t("events"), {"event_type": F.col("event_type"), "h": F.hour("ts").cast("long")}, "value")
    return b.withColumn("mean", F.round("mean", 6))


@query("G28 G32", "SELECT l_suppkey, l_linenumber, round(median(nullif(l_discount, 0)), 6) AS med, count(nullif(l_discount, 0)) AS valid, max(l_tax) AS top FROM lineitem GROUP BY 1, 2")
def consensus_median(t):
    v = F.nullif(F.col("l_discount"), F.lit(0.0))
    return t("lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.round(F.median(v), 6).alias("med"), F.count(v).alias("valid"), F.max("l_tax").alias("top"))


@query(
    "G24",
    """WITH p AS (SELECT l_partkey % 200 AS k, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS s, l_quantity AS v FROM lineitem)
SELECT a.k AS k, round(sum(abs(a.v - b.v)), 4) AS total, count(*) AS pairs, round(avg(abs(a.v - b.v)), 6) AS mean FROM p a JOIN p b ON a.k = b.k AND a.s = 0 AND b.s = 1 GROUP BY 1""",
)
def all_pairs_l1(t):
    p = t("lineitem").select((F.col("l_partkey") % 200).alias("k"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("s"), F.col("l_quantity").alias("v"))
    return aggs.all_pairs_l1(p, "k", "s", "v").where("pairs > 0").select("k", F.round("total", 4).alias("total"), "pairs", F.round("mean", 6).alias("mean"))


@query(
    "G22 G23 G25 F06",
    """SELECT l_suppkey, round((sum(l_discount ** 2) / count(*)) ** 0.5, 8) AS rms, round(sum(CASE WHEN l_tax > 0.03 THEN l_quantity ELSE 0 END) / greatest(count(*) FILTER (l_tax > 0.03), 1), 6) AS masked,
  round(sum(l_tax * l_quantity) / greatest(sum(l_tax), 0.05 * count(*)), 6) AS nominal, round(sum(CASE WHEN abs(l_quantity - 25) <= 10 THEN 0.5 * (l_quantity - 25) ** 2 ELSE 10 * (abs(l_quantity - 25) - 5) END), 4) AS huber FROM lineitem GROUP BY 1""",
)
def masked_power_nominal_means(t):
    return t("lineitem").groupBy("l_suppkey").agg(
        F.round(aggs.power_mean("l_discount", 2.0), 8).alias("rms"), F.round(aggs.masked_mean("l_quantity", F.col("l_tax") > 0.03), 6).alias("masked"),
        F.round(aggs.nominal_mass_mean("l_quantity", "l_tax", 0.05), 6).alias("nominal"), F.round(F.sum(expr.huber(F.col("l_quantity") - 25, 10.0)), 4).alias("huber"),
    )


@query(
    "G20 G21 S11",
    """WITH q AS (SELECT quantile_cont(o_totalprice, 1 / 3.0) AS lo, quantile_cont(o_totalprice, 2 / 3.0) AS hi FROM orders)
SELECT CASE WHEN o_totalprice <= lo THEN 0 WHEN o_totalprice <= hi THEN 1 ELSE 2 END AS bin, count(*) AS n, round(1.0 / 3 / count(*), 10) AS weight, round(max(o_totalprice), 2) AS top FROM orders, q GROUP BY 1""",
)
def tertile_bins_weights(t):
    b = aggs.tertiles(t("orders"), None, "o_totalprice")
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.lit(1.0) / 3 / F.count("*"), 10).alias("weight"), F.round(F.max("o_totalprice"), 2).alias("top"))


@query("G20 G42", "SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg((value <= 0)::INT), 8) AS none, round(avg((value > 100)::INT), 8) AS saturated FROM events GROUP BY 1")
def quantile_fractions(t):
    q = aggs.exact_quantiles(t("events"), ["event_type"], "value", 0.05, 0.5, 0.95)
    f = t("events").groupBy("event_type").agg(F.round(F.avg((F.col("value") <= 0).cast("int")), 8).alias("none"), F.round(F.avg((F.col("value") > 100).cast("int")), 8).alias("saturated"))
    return f.join(q, "event_type").select("event_type", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p5", "p50", "p95"))], "none", "saturated")


@query(
    "G27",
    """WITH m AS (SELECT l_orderkey AS k, avg(l_quantity) AS mean, quantile_disc(l_quantity, 0.5) AS med FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(sum(abs(l_quantity - mean)), 6) AS off_mean, round(sum(abs(l_quantity - med)), 6) AS off_median FROM lineitem JOIN m ON l_orderkey = k GROUP BY 1""",
)
def group_targets(t):
    line = t("lineitem").select("l_orderkey", "l_quantity")
    m = line.groupBy("l_orderkey").agg(F.avg("l_quantity").alias("mean"), aggs.lower_median("l_quantity").alias("med"))
    off = lambda c: F.round(F.sum(F.abs(F.col("l_quantity") - F.col(c))), 6)
    return line.join(m, "l_orderkey").groupBy("l_orderkey").agg(off("mean").alias("off_mean"), off("med").alias("off_median"))


@query("G16 G17 G38 G39 G44 G46", "SELECT o_custkey % 100 AS k, round(min(o_totalprice), 2) AS low, round(max(o_totalprice), 2) AS high, round(avg(o_totalprice), 4) AS centre, CAST(max(o_custkey) + 1 AS BIGINT) AS extent, bool_or(o_orderstatus = 'F') AS any_f, coalesce(max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), -1) + 5 AS bound FROM orders GROUP BY 1")
def extents_with_defaults(t):
    o = t("orders")
    p = F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")))
    return o.groupBy((F.col("o_custkey") % 100).alias("k")).agg(
        F.round(F.min("o_totalprice"), 2).alias("low"), F.round(F.max("o_totalprice"), 2).alias("high"), F.round(F.avg("o_totalprice"), 4).alias("centre"),
        (F.max("o_custkey") + 1).alias("extent"), F.bool_or(F.col("o_orderstatus") == "F").alias("any_f"), (F.coalesce(p, F.lit(-1.0)) + 5).alias("bound"),
    )


@query(
    "C15 C16",
    """WITH g AS (SELECT l_orderkey AS k, count(*) FILTER (l_returnflag = 'A') AS attached, count(*) FILTER (l_returnflag <> 'A') AS loose, bool_or(l_tax >= 0.08) AS marked FROM lineitem GROUP BY 1)
SELECT k, 'cross' AS class, marked FROM g WHERE attached >= 2 UNION ALL SELECT k, 'unattached', marked FROM g WHERE loose >= 1""",
)
def attachment_classes(t):
    on = F.col("l_returnflag") == "A"
    g = t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.when(on, 1)).alias("attached"), F.count(F.when(~on, 1)).alias("loose"), F.bool_or(F.col("l_tax") >= 0.08).alias("marked"))
    cross, loose = g.where("attached >= 2"), g.where("loose >= 1")
    return cross.select("k", F.lit("cross").alias("class"), "marked").unionByName(loose.select("k", F.lit("unattached").alias("class"), "marked"))


@query(
    "C17 C20",
    """WITH j AS (SELECT d.doc_id, source, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), c AS (SELECT *, count(*) OVER (PARTITION BY source) AS n, count(quality) OVER (PARTITION BY source) AS m FROM j)
SELECT doc_id, coalesce(quality, 0) AS annotation, m > 0 AS annotated FROM c WHERE NOT (m > 0 AND m < n AND quality IS NULL)""",
)
def annotation_normalise(t):
    j = t("documents").select("doc_id", "source").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    c = j.groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("m")).withColumnRenamed("source", "s")
    j = j.join(c, F.col("source").eqNullSafe(F.col("s"))).where("not (m > 0 and m < n and quality is null)")
    return j.select("doc_id", F.coalesce("quality", F.lit(0)).alias("annotation"), (F.col("m") > 0).alias("annotated"))


@query(
    "S12",
    """WITH g AS (SELECT c_mktsegment AS s, count(*) AS size FROM customer GROUP BY 1), q AS (SELECT *, 103.0 / count(*) OVER () AS share, floor(103.0 / count(*) OVER ()) AS base FROM g),
r AS (SELECT *, row_number() OVER (ORDER BY round(base - share, 9), s) AS rn, 103 - sum(base) OVER () AS rest FROM q), u AS (SELECT s, size, CAST(base + (rn <= rest)::INT AS BIGINT) AS quota FROM r),
h AS (SELECT c_mktsegment AS s, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY ('0x' || md5('7:' || c_custkey)[1:15])::BIGINT, c_custkey) AS rn FROM customer)
SELECT h.s AS c_mktsegment, c_custkey, quota, CAST((quota - h.rn) // size + 1 AS BIGINT) AS copies FROM h JOIN u ON h.s = u.s WHERE h.rn <= quota""",
)
def stratified_quota(t):
    return sampling.stratified_quota(t("customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey", 103, "7")


@query(
    "S16",
    """WITH h AS (SELECT s_nationkey AS k, s_suppkey, round(-ln((('0x' || md5('3:' || s_suppkey)[1:15])::BIGINT + 1) / 1152921504606846976.0) / s_acctbal, 12) AS d FROM supplier WHERE s_acctbal > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, s_suppkey) AS rn FROM h) SELECT k, s_suppkey, CAST(rn AS BIGINT) AS rn FROM r WHERE rn <= 2""",
)
def weighted_without_replacement(t):
    s = t("supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey", "s_acctbal")
    return sampling.weighted_order(s, "s_suppkey", "s_acctbal", 2, "3", "k").select("k", "s_suppkey", F.col("rn").cast("long").alias("rn"))


@query("S13 S01", "SELECT o_orderkey FROM orders ORDER BY ('0x' || md5('9:' || o_orderkey)[1:15])::BIGINT, o_orderkey LIMIT 250")
def uniform_sample(t):
    return sampling.hash_sample(t("orders").select("o_orderkey"), "o_orderkey", 250, "9").select("o_orderkey")


@query("A18 F17", "SELECT ('0x' || md5('0:' || c_name)[1:15])::BIGINT % 8 AS shard, count(*) AS n, min(sha256(c_name)) AS digest FROM customer GROUP BY 1")
def hash_shard(t):
    c = t("customer").select((expr.stable_hash("c_name") % 8).alias("shard"), F.sha2("c_name", 256).alias("digest"))
    return c.groupBy("shard").agg(F.count("*").alias("n"), F.min("digest").alias("digest"))


@query("A11 A26 S20 C04", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) SELECT o_orderkey FROM r WHERE (rn - 1) % 50 = 0")
def systematic_sample(t):
    return sampling.systematic(t("orders").select("o_orderkey"), "o_orderkey", 50).select("o_orderkey")


@query(
    "S21",
    """WITH c AS (SELECT DISTINCT l_suppkey AS i, l_partkey % 64 AS j FROM lineitem), b AS (SELECT i, j, i // 8 AS bi, j // 8 AS bj, (i - (i // 8 * 8 + 3.5)) ** 2 + (j - (j // 8 * 8 + 3.5)) ** 2 AS d FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY bi, bj ORDER BY d, i, j) AS rn FROM b) SELECT bi, bj, i, j FROM r WHERE rn = 1""",
)
def block_representatives(t):
    c = t("lineitem").select(F.col("l_suppkey").alias("i"), (F.col("l_partkey") % 64).alias("j")).distinct()
    return sampling.block_representatives(c, ("i", "j"), 8, [])


@query(
    "F02 F04 F05 F07 F08 F14 F23 F24 S24 S25",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(pi() * 0 + atan2(l_quantity, l_tax + 1), 8) AS angle, CAST(round_even(l_quantity / 4, 0) AS BIGINT) AS even, CAST(floor(l_quantity / 4 + 0.5) AS BIGINT) AS up,
  (CAST(l_partkey % 1000 AS BIGINT) << 40) | (CAST(l_suppkey AS BIGINT) << 20) | l_linenumber AS cell, CASE WHEN l_quantity % 5 <> 0 THEN (l_quantity - 25) * 0.5 END AS sdt, round((l_quantity - 128) / 127.0, 8) AS part,
  round(l_extendedprice / 4, 4) AS coarse, greatest(3, CAST(round_even(l_quantity * 0.3, 0) AS BIGINT)) AS samples, round(least(1, greatest(0, (l_quantity - 10) / 30)), 8) AS ramp, round(cos(l_tax) * l_quantity, 6) AS x FROM lineitem""",
)
def scalar_functions(t):
    q = F.col("l_quantity")
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(expr.theta("l_quantity", F.col("l_tax") + 1), 8).alias("angle"), expr.half_even(q / 4).cast("long").alias("even"), expr.half_up(q / 4).alias("up"),
        expr.pack_cell(F.col("l_partkey") % 1000, "l_suppkey", "l_linenumber").alias("cell"), F.when(q % 5 != 0, expr.decode_distance(q, 25.0, 0.5)).alias("sdt"), F.round(expr.decode_component(q), 8).alias("part"),
        F.round(expr.at_level("l_extendedprice", 0, 2), 4).alias("coarse"), F.greatest(F.lit(3), expr.half_even(q * 0.3).cast("long")).alias("samples"), F.round(expr.ramp(q, 10.0, 40.0), 8).alias("ramp"), F.round(F.cos("l_tax") * q, 6).alias("x"),
    )


@query(
    "C18 F16 A19",
    """WITH n AS (SELECT p_partkey, p_brand || '__' || p_type || '__x' AS nm FROM part), k AS (SELECT DISTINCT p_brand AS b FROM part), r AS (SELECT DISTINCT p_type || '__x' AS t FROM part),
s AS (SELECT p_partkey, nm, unnest(generate_series(1, length(nm) - 2)) AS i FROM n), c AS (SELECT p_partkey, i, nm[1:i - 1] AS a, nm[i + 2:] AS z FROM s WHERE nm[i:i + 1] = '__'),
v AS (SELECT c.*, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS rn FROM c JOIN k ON a = b JOIN r ON z = t)
SELECT p_partkey, a AS first_name, z AS second_name, CAST(nullif(regexp_extract(a, '([0-9]+)$', 1), '') AS INTEGER) AS suffix FROM v WHERE rn = 1""",
)
def split_name_pairs(t):
    p = t("part").select("p_partkey", F.concat_ws("__", "p_brand", "p_type", F.lit("x")).alias("nm"))
    s = p.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("nm") - 2))).where(F.substring("nm", F.col("i"), F.lit(2)) == "__")
    s = s.select("p_partkey", "i", F.substring("nm", F.lit(1), F.col("i") - 1).alias("a"), F.substring("nm", F.col("i") + 2, F.length("nm")).alias("z"))
    s = s.join(t("part").select(F.col("p_brand").alias("a")).distinct(), "a", "left_semi").join(t("part").select(F.concat_ws("__", "p_type", F.lit("x")).alias("z")).distinct(), "z", "left_semi")
    f = joins.first_per_key(s, "p_partkey", ["i"])
    return f.select("p_partkey", F.col("a").alias("first_name"), F.col("z").alias("second_name"), F.expr("try_cast(nullif(regexp_extract(a, '([0-9]+)$', 1), '') as int)").alias("suffix"))


_HASH = "('0x' || md5('{0}:' || {1})[1:15])::BIGINT"


@query(
    "S10",
    f"""WITH c AS (SELECT c_custkey, CAST(floor(sqrt(c_acctbal) * 1000) AS BIGINT) AS w FROM customer WHERE c_acctbal > 0), s AS (SELECT *, CAST(sum(w) OVER (ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM c WHERE w > 0),
d AS (SELECT draw, {_HASH.format(11, "draw")} % (SELECT max(upto) FROM s) AS u FROM (SELECT unnest(generate_series(0, 499)) AS draw)) SELECT draw, c_custkey FROM d JOIN s ON u >= upto - w AND u < upto""",
)
def weighted_draws(t):
    c = t("customer").where("c_acctbal > 0").select("c_custkey", F.floor(F.sqrt("c_acctbal") * 1000).alias("w"))
    return sampling.weighted_draws(c, "c_custkey", "w", 500, "11")


@query(
    "S19",
    f"""WITH m AS (SELECT s_nationkey AS k, max(s_acctbal) AS top FROM supplier WHERE s_acctbal > 0 GROUP BY 1), f AS (SELECT k, s_suppkey, round(-ln(({_HASH.format(13, "s_suppkey")} + 1) / 1152921504606846976.0) / (s_acctbal / top) ** 2, 12) AS d FROM supplier JOIN m ON k = s_nationkey WHERE s_acctbal >= 0.5 * top),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, s_suppkey) AS rn FROM f), n AS (SELECT k, count(*) AS n FROM r WHERE rn <= 4 GROUP BY 1) SELECT k, s_suppkey, CAST(unnest(generate_series(rn, 4, n)) AS BIGINT) AS rn FROM r JOIN n USING (k) WHERE rn <= 4""",
)
def distant_endpoints(t):
    s = t("supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey", "s_acctbal")
    return sampling.distant_endpoints(s, "k", "s_suppkey", "s_acctbal", 4, "13")


def _diverse(n: int) -> str:
    """One step for each seed: the gaps to those before, their upper quarter, and the first by hash."""
    out = ["c AS (SELECT s_suppkey, s_acctbal AS y, s_nationkey * 400.0 AS x FROM supplier, (SELECT quantile_cont(s_acctbal, 0.75) AS cut FROM supplier) WHERE s_acctbal >= cut)"]
    for k in range(n):
        if k == 0:
            out.append("g0 AS (SELECT *, 0 AS gap FROM c)")
        else:
            gaps = ", ".join(f"sqrt((c.y - t{i}.y) ** 2 + (c.x - t{i}.x) ** 2)" for i in range(k))
            others = ", ".join(f"t{i}" for i in range(k))
            out.append(f"g{k} AS (SELECT c.*, round(least({gaps}), 9) AS gap FROM c, {others} WHERE {' AND '.join(f'c.s_suppkey <> t{i}.s_suppkey' for i in range(k))})")
        h = _HASH.format(17, f"{k} || ':' || s_suppkey")
        out.append(f"t{k} AS (SELECT s_suppkey, y, x FROM g{k} WHERE gap >= (SELECT quantile_cont(gap, 0.75) FROM g{k}) ORDER BY {h}, s_suppkey LIMIT 1)")
    return f"WITH {', '.join(out)} " + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS rank, s_suppkey, y, x FROM t{k}" for k in range(n))


@query(
    "S18",
    f"""SELECT event_id, CAST(least(greatest(ceil(sqrt(2 * ({_HASH.format(23, "event_id")} / 1152921504606846976.0) * ((41.0 + user_id % 10) * (41.0 + user_id % 10) - 9) / 2 + 9) - 1), 3.0), 40.0 + user_id % 10) AS BIGINT) AS winding FROM events""",
)
def circumference_windings(t):
    """A winding from 3 up to each user's outermost one, for each event."""
    u = expr.stable_hash("event_id", seed="23") / 1152921504606846976.0
    return t("events").select("event_id", expr.winding_by_circumference(u, 3, 40 + F.col("user_id") % 10).alias("winding"))


@query("S15", _diverse(3))
def diverse_seeds(t):
    s = t("supplier").select("s_suppkey", "s_acctbal", F.col("s_acctbal").alias("y"), (F.col("s_nationkey") * 400).cast("double").alias("x"))
    return sampling.diverse_seeds(s, "s_suppkey", "s_acctbal", ["y", "x"], 3, "17")


@query(
    "S07 S08",
    """WITH r AS (SELECT user_id, max(event_id) AS stamp FROM events WHERE event_type = 'view' AND value > 40 GROUP BY 1), w AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 40),
j AS (SELECT w.user_id, CASE WHEN stamp IS NULL THEN 'load' ELSE 'hit' END AS action FROM w LEFT JOIN r USING (user_id)), n AS (SELECT greatest(count(*) FILTER (action = 'load') - 3, 0) AS need FROM j),
o AS (SELECT user_id, row_number() OVER (ORDER BY stamp, user_id) AS rn FROM r ANTI JOIN w USING (user_id)) SELECT * FROM j UNION ALL SELECT user_id, 'evict' FROM o, n WHERE rn <= need""",
)
def cache_plan(t):
    e = t("events").select("user_id", "event_id", "event_type", "value")
    held = e.where("event_type = 'view' and value > 40")
    room = held.select("user_id").distinct().count() + 3
    return sampling.eviction_plan(held, e.where("event_type = 'purchase' and value > 40"), "user_id", "event_id", room)


@query(
    "K18",
    f"""WITH RECURSIVE p AS (SELECT s_suppkey AS id, s_nationkey AS y, CAST(floor(s_acctbal / 700) AS BIGINT) AS x, {_HASH.format(19, "s_suppkey")} AS h, row_number() OVER (ORDER BY {_HASH.format(19, "s_suppkey")}, s_suppkey) AS rn, row_number() OVER (ORDER BY s_suppkey) - 1 AS rank FROM supplier),
w AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(id BIGINT, y BIGINT, x BIGINT, label BIGINT, forced BOOLEAN)[]) AS done UNION ALL
  SELECT n.rn, list_append(done, struct_pack(id := CAST(n.id AS BIGINT), y := CAST(n.y AS BIGINT), x := n.x, label := CAST(coalesce(list_filter(list_transform(generate_series(0, 4), lambda k: 1 + (n.rank + k) % 5), lambda l: NOT list_contains(used, l))[1],
      list_sort(list_transform(list_distinct(used), lambda l: struct_pack(n := len(list_filter(used, lambda u: u = l)), k := l)))[1].k) AS BIGINT), forced := len(list_distinct(used)) = 5))
  FROM (SELECT p.*, done, list_transform(list_filter(done, lambda d: abs(d.y - p.y) <= 1 AND abs(d.x - p.x) <= 1), lambda d: d.label) AS used FROM w JOIN p ON p.rn = w.rn + 1) n),
u AS (SELECT unnest(done) AS d FROM w WHERE rn = (SELECT max(rn) FROM p)) SELECT d.id AS s_suppkey, d.label AS label, d.forced AS forced FROM u""",
)
def spatial_labels(t):
    c = t("supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("y"), F.floor(F.col("s_acctbal") / 700).alias("x"))
    return sampling.spatial_labels(c, "s_suppkey", ["y", "x"], 5, 1, "19")


@query(
    "S22",
    """WITH c AS (SELECT DISTINCT l_suppkey AS i, l_partkey % 50 AS j FROM lineitem WHERE l_quantity > 20), r AS (SELECT i, j, j - row_number() OVER (PARTITION BY i ORDER BY j) AS run FROM c), e AS (SELECT i, run, min(j) AS lo, max(j) AS hi FROM r GROUP BY 1, 2),
a AS (SELECT s_suppkey AS i, s_suppkey * 7 % 50 AS j FROM supplier) SELECT a.i AS i, a.j AS anchor_j, k AS rank, CAST(round_even(lo + (hi - lo) * k / 4.0, 0) AS BIGINT) AS j FROM (SELECT *, unnest([0, 1, 2, 3, 4]) AS k FROM a) a JOIN e ON e.i = a.i AND a.j BETWEEN lo AND hi""",
)
def strip_samples(t):
    c = t("lineitem").where("l_quantity > 20").select(F.col("l_suppkey").alias("i"), (F.col("l_partkey") % 50).alias("j"))
    a = t("supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_suppkey") * 7 % 50).alias("j"))
    return sampling.strips(c, [], "i", "j", a, 5, "j").select("i", "anchor_j", "rank", "j")


@query(
    "F11",
    """WITH m AS (SELECT event_id, value / 100 AS a, (user_id % 7 - 3) / 4 AS b, (event_id % 5 - 2) / 3 AS c, (event_id % 11 - 5) / 10 AS d FROM events), s AS (SELECT *, (a + d) / 2 AS s, (a - d) * (a - d) / 4 + b * c AS q2, sqrt(abs((a - d) * (a - d) / 4 + b * c)) AS q FROM m),
e AS (SELECT *, CASE WHEN q2 >= 0 THEN (exp(q) + exp(-q)) / 2 ELSE cos(q) END AS ev, CASE WHEN q < 1e-8 THEN 1.0 WHEN q2 >= 0 THEN (exp(q) - exp(-q)) / 2 / q ELSE sin(q) / q END AS od FROM s)
SELECT event_id, round(exp(s) * (ev + od * (a - s)), 6) AS m11, round(exp(s) * od * b, 6) AS m12, round(exp(s) * od * c, 6) AS m21, round(exp(s) * (ev + od * (d - s)), 6) AS m22 FROM e""",
)
def matrix_exponentials(t):
    e = t("events").select("event_id", (F.col("value") / 100).alias("a"), ((F.col("user_id") % 7 - 3) / 4).alias("b"), ((F.col("event_id") % 5 - 2) / 3).alias("c"), ((F.col("event_id") % 11 - 5) / 10).alias("d"))
    m = expr.expm_2x2("a", "b", "c", "d")
    return e.select("event_id", *[F.round(x, 6).alias(n) for x, n in zip(m, ("m11", "m12", "m21", "m22"), strict=True)])
