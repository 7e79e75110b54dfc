"""Small cases with known answers, and fast forms against plain ones."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import expr
from spanloom.operators import aggs, graph, greedy, joins, ragged, raster, sampling
from spanloom.sources import files
from spanloom.streaming import log


def test_two_lines_cross_once(spark):
    rows = [(0, "h", i, 10, 10, i) for i in range(21)] + [(1, "v", i, 10, i, 10) for i in range(21)] + [(2, "h", i, 30, 10, i) for i in range(21)]
    p = spark.createDataFrame(rows, "track bigint, fam string, idx int, z bigint, y bigint, x bigint").withColumn("cell", expr.pack_cell("z", "y", "x"))
    e = joins.crossing_events(p, "track", "cell", "idx", "fam")
    assert [tuple(r) for r in e.select("a", "b", "a_idx", "b_idx").collect()] == [(0, 1, 10, 10)]
    degree = joins.both_ways(e).groupBy(F.col("src").alias("track")).agg(F.count("*").alias("n"))
    assert [r.n for r in aggs.zero_filled(p, degree, "track", "n").orderBy("track").collect()] == [1, 1, 0]


def test_partners_are_the_crossings_of_each_track(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(40), rng.randrange(9), rng.randrange(5), rng.choice("abc")) for _ in range(300)] + [(k, None, 1, "a") for k in range(3)] + [(41, 3, 0, None)]
    p = spark.createDataFrame(rows, "track bigint, cell bigint, idx int, fam string")
    for fam in ("fam", None):
        want = sorted(map(tuple, joins.crossing_events(p, "track", "cell", "idx", fam).select("a", "b", "a_idx", "b_idx").collect()))
        for chunk in (1024, 4):
            assert sorted(map(tuple, joins.later(joins.partners(p, "track", "cell", "idx", fam, True, chunk)).collect())) == want
            m = joins.partners(p, "track", "cell", "idx", fam, False, chunk).collect()
            assert sorted((r.track, x.track) for r in m for x in r.them) == sorted([(a, b) for a, b, *_ in want] + [(b, a) for a, b, *_ in want])


def test_records_without_their_mirror(spark):
    rows = [(1, 2, 0, 3), (2, 1, 3, 0), (1, 3, 0, 0), (4, 4, 1, 1), (4, 4, 1, 2), (5, 6, 0, 0), (5, 6, 0, 0), (6, 5, 0, 0)]
    r = joins.reciprocity(spark.createDataFrame(rows, "src bigint, dst bigint, s int, d int")).first()
    assert tuple(r) == (7, 4)
    # Dealt by the lesser end, they are not shuffled by pair again.
    dealt = spark.createDataFrame([(1, 1, 2, 0, 3)], "low bigint, src bigint, dst bigint, s int, d int").repartition("low")
    plan = joins.reciprocity(dealt, "low")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and plan.count("Exchange hashpartitioning") == 1


def test_neighbours_are_counted_and_listed_once(spark):
    met = spark.createDataFrame([(1, [2, 3]), (1, [3, 4]), (2, [1]), (3, [])], "k bigint, ids array<bigint>")
    assert sorted(map(tuple, joins.neighbour_counts(met, "k", "n", F.sum(F.size("ids")).alias("all")).collect())) == [(1, 3, 4), (2, 1, 1)]
    assert sorted(map(tuple, joins.neighbours(met, "k", "o").collect())) == [(1, 2), (1, 3), (1, 4), (2, 1)]
    # No pair is hashed with its track on either side of the shuffle.
    plan = joins.neighbour_counts(met, "k", "n")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_packed_cells(spark):
    df = spark.createDataFrame([(1, 2, 3), (0, 0, (1 << 20) - 1)], "z bigint, y bigint, x bigint")
    back = df.select(*expr.unpack_cell(expr.pack_cell("z", "y", "x"))).collect()
    assert [tuple(r) for r in back] == [(1, 2, 3), (0, 0, (1 << 20) - 1)]
    with pytest.raises(Exception, match="packed range"):
        df.select(expr.pack_cell("z", "y", F.col("x") + 1)).collect()


def test_polyline_cells(spark):
    p = spark.createDataFrame([(0, 0, 1, 2, 3), (0, 1, 1, 2, 7), (0, 2, 3, 4, 7)], "k int, pos int, z int, y int, x int")
    got = ragged.rasterized(p, "k", "pos", ["z", "y", "x"]).orderBy("segment", "step").select("z", "y", "x").collect()
    assert [tuple(r) for r in got] == [(1, 2, 3), (1, 2, 4), (1, 2, 5), (1, 2, 6), (1, 2, 7), (2, 3, 7), (3, 4, 7)]


def test_unwrap_over_the_seam(spark):
    p = spark.createDataFrame([(0, i, a, 100.0) for i, a in enumerate([6.0, 6.2, 0.1, 0.3, 6.1])], "k int, pos int, angle double, r double")
    got = ragged.unwrapped(p, "k", "pos", "angle", "r", 10.0).orderBy("pos").collect()
    assert [r.unwrapped for r in got] == [100, 100, 90, 90, 100]


def test_longest_run_is_the_earliest_of_equals(spark):
    on = [1, 1, 0, 1, 1, 0, 1, None]
    p = spark.createDataFrame([(0, i, v) for i, v in enumerate(on)] + [(1, 0, 1)], "k int, pos int, v int")
    assert [tuple(r) for r in ragged.longest_run(p, "k", "pos", F.col("v") == 1).collect()] == [(0, 0, 1, 2)]


def test_medians_and_modes(spark):
    d = spark.createDataFrame([(0, v) for v in (1.0, 2.0, 3.0, 4.0)] + [(1, 5.0), (1, 5.0), (1, 2.0), (1, 2.0), (1, None)], "k int, v double")
    r = d.groupBy("k").agg(aggs.lower_median("v").alias("low"), aggs.median("v").alias("mid")).orderBy("k").collect()
    assert [(x.low, x.mid) for x in r] == [(2.0, 2.5), (2.0, 3.5)]
    assert [tuple(x) for x in aggs.mode(d, "k", "v").orderBy("k").collect()] == [(0, 1.0, 1), (1, 2.0, 2)]


def test_near_pairs_are_all_pairs_in_reach(spark):
    rng = random.Random(1)
    a, b = [[(i, rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(60)] for _ in range(2)]
    b += [(60, a[0][1] + 1.0, a[0][2])]
    left, right = spark.createDataFrame(a, "i int, x double, y double"), spark.createDataFrame(b, "j int, u double, v double")
    got = {(r.i, r.j) for r in joins.near_pairs(left, right, [("x", "u"), ("y", "v")], 1.0).collect()}
    assert got == {(i, j) for i, x, y in a for j, u, v in b if math.sqrt((x - u) ** 2 + (y - v) ** 2) <= 1.0}
    far = {r.i for r in joins.radius_anti(left, right, "i", [("x", "u"), ("y", "v")], 1.0).collect()}
    assert far == {i for i, *_ in a} - {i for i, _ in got}
    assert joins.radius_anti(left, right, "i", [("x", "u")], 0).count() == 60


def test_all_pairs_by_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), rng.randrange(2), float(rng.randrange(9))) for _ in range(80)] + [(7, 1, 1.0)]
    got = {r.k: (r.total, r.pairs) for r in aggs.all_pairs_l1(spark.createDataFrame(rows, "k int, s int, v double"), "k", "s", "v").collect()}
    for k in (0, 1, 2, 7):
        pairs = [abs(a[2] - b[2]) for a in rows for b in rows if a[0] == b[0] == k and a[1] == 0 and b[1] == 1]
        assert got[k] == (sum(pairs), len(pairs))


def test_quotas(spark):
    d = spark.createDataFrame([(g, i) for i, g in enumerate("aabbcc")], "grp string, id int")
    assert sorted((r.grp, r.copies) for r in sampling.stratified_quota(d, "grp", "id", 3, "s").collect()) == [("a", 1), ("b", 1), ("c", 1)]
    only = sampling.stratified_quota(d, "grp", "id", 5, "s", {"a": 0.0, "b": 1.0, "c": 0.0}).collect()
    assert {r.grp for r in only} == {"b"} and sum(r.copies for r in only) == 5
    with pytest.raises(Exception, match="no weight"):
        sampling.stratified_quota(d, "grp", "id", 3, "s", {"a": 1.0}).collect()
    assert [r.i for r in spark.range(1).select(F.explode(sampling.even_indices(F.lit(11), 5)).alias("i")).collect()] == [0, 2, 5, 8, 10]


def test_spaced_selection(spark):
    c = spark.createDataFrame([(0, p, 1.0, i) for i, p in enumerate([0.0, 1.0, 5.0, 9.0, 10.0])], "k int, p double, c double, id bigint")
    assert [r.id for r in sampling.spaced_top_k(c, "k", "p", "c", "id", 3).orderBy("rank").collect()] == [0, 4, 2]
    assert [r.id for r in sampling.spaced_top_k(c.withColumn("c", F.col("id") % 3), "k", "p", "c", "id", 1).collect()] == [2]


def test_decimation_with_and_without_the_last(spark):
    d = spark.createDataFrame([([0.0, 1.0, 2.5, 3.0, 6.0, 6.5],)], "x array<double>")
    kept = lambda last: d.select(ragged.spaced(F.col("x"), lambda a, b: b - a, 2.0, last).alias("k")).first().k
    assert kept(False) == [0.0, 2.5, 6.0] and kept(True) == [0.0, 2.5, 6.0, 6.5]


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 4, 1), (1, 4, 2), (8, 9, 0)], "src bigint, dst bigint, delta bigint")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (-F.col("delta")).alias("delta")))
    tree = graph.breadth_first(both, spark.createDataFrame([(1,)], "node bigint"), 5)
    assert sorted((r.node, r.depth, r.acc) for r in tree.collect()) == [(1, 0, 0), (2, 1, 1), (3, 2, 1), (4, 1, 2)]
    assert [tuple(r) for r in graph.holonomy(both, tree).collect()] == [(2, 3, 1)]
    ab = e.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    assert sorted(tuple(r) for r in graph.components(ab).collect()) == [(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)]
    assert graph.components(ab.where("a > 100")).count() == 0
    square = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (1, 4)], "a bigint, b bigint")
    assert {r.node: r.triangles for r in graph.triangles(square).collect()} == {1: 2, 2: 1, 3: 2, 4: 1}


def test_grids(spark):
    cells = spark.createDataFrame([(i, j, float(i * j)) for i in range(5) for j in range(5) if (i, j) != (4, 4)], "i bigint, j bigint, v double")
    assert raster.valid_quads(cells, "i", "j", []).count() == 15
    assert sorted(tuple(r) for r in raster.eroded(cells, ["i", "j"], 1).collect()) == [(i, j) for i in (1, 2, 3) for j in (1, 2, 3)]
    at = spark.createDataFrame([(0, 0.5, 1.5), (1, 3.5, 3.5), (2, 2.0, 3.0)], "id int, i double, j double")
    assert {r.id: r.v for r in raster.bilinear(at, cells, [], "i", "j", "v").collect()} == {0: 0.75, 1: None, 2: 6.0}


def test_log_pages(spark):
    ring = spark.range(1, 101).withColumnRenamed("id", "seq")
    page = lambda cursor: log.page(ring, "seq", cursor, 5, ring=20).collect()
    assert [r.seq for r in page(95)] == [96, 97, 98, 99, 100] and page(95)[0].dropped == 0
    lost = page(10)
    assert lost[0].seq == 81 and lost[0].dropped == 70 and lost[0].next_cursor == 85
    reset = page(500)
    assert reset[0].cursor_reset and reset[0].seq == 81
    assert page(100) == []


def test_point_collections_and_fibres(spark, tmp_path):
    doc = {"vc_pointcollections_json_version": "1", "collections": {"0": {"name": "col-a", "points": {"0": {"p": [1, 2, 3], "wind_a": 1.5}, "1": {"p": [4, 5, 6]}}}}}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({**doc, "vc_pointcollections_json_version": "2"}))
    got = files.point_collections(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json")).orderBy("point_id").collect()
    assert [(r.collection_id, r.name, r.point_id, r.z, r.y, r.x, r.winding) for r in got] == [(0, "col-a", 0, 3, 2, 1, 1.5), (0, "col-a", 1, 6, 5, 4, None)]
    (tmp_path / "f.json").write_text(json.dumps({"type": "t", "name": "n", "control_points": [[4, 8, 12], [1]], "hv_classification": {"automatic_tag": "h"}}))
    assert [(r.tag, r.pos, r.z, r.y, r.x) for r in files.fibres(spark, str(tmp_path / "f.json")).collect()] == [("h", 0, 3.0, 2.0, 1.0)]
    (tmp_path / "axis.txt").write_text("10, 1, 2\n5, 3, 4\n")
    assert [tuple(r) for r in files.axis_points(spark, str(tmp_path / "axis.txt")).collect()] == [(5.0, 3.0, 4.0), (10.0, 1.0, 2.0)]


def test_track_store_and_resumed_writes(spark, tmp_path):
    p = spark.createDataFrame([(t, i, float(10 * t + i), float(i), 0.0) for t in range(4) for i in range(5)], "source_id bigint, pos int, z double, y double, x double")
    files.write_tracks(p, str(tmp_path / "tracks"))
    got = files.tracks_within(spark, str(tmp_path / "tracks"), 10, 30)
    assert sorted(r.source_id for r in got.collect()) == [1, 2] and "PushedFilters: [IsNotNull(z_min)" in got._jdf.queryExecution().toString()
    store = spark.read.parquet(str(tmp_path / "tracks"))
    manifest = spark.createDataFrame(files.fingerprints(store).collect())
    assert files.is_current(store, manifest)
    jobs = spark.createDataFrame([(1, "a"), (2, "b")], "part int, v string")
    for _ in range(2):
        files.write_new_partitions(jobs, str(tmp_path / "out"), "part")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    files.write_flat_metrics(store, str(tmp_path / "metrics"))
    assert "points" not in spark.read.option("header", True).csv(str(tmp_path / "metrics/csv")).columns
    v = spark.createDataFrame([(i, j, 1.0, 2.0, 3.0) for i in range(2) for j in range(3) if (i, j) != (1, 2)], "i int, j int, x double, y double, z double")
    files.write_mesh(v, spark.createDataFrame([(0, 0), (0, 1)], "i int, j int"), str(tmp_path / "mesh"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "mesh")).collect()]
    assert sorted(lines)[0] == "f 1 2 5 4" and len(lines) == 6
    assert files.settings_key(a=1, b=2) == files.settings_key(b=2, a=1) != files.settings_key(a=1)


def test_streams(spark, tmp_path):
    rows = [("c1", "2024-01-01 00:00:00", 1), ("c1", "2024-01-01 00:00:05", 1), ("c2", "2024-01-01 00:01:00", 0)]
    df = spark.createDataFrame(rows, "command string, at string, ok int").withColumn("at", F.col("at").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = log.deduplicated_stream(stream(), "command", "at", "1 hour").writeStream.format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.command for r in spark.sql("select * from once").collect()) == ["c1", "c2"]
    q = log.windowed_stream(stream(), "at", "1 minute", "1 minute", None, "command").writeStream.format("memory").outputMode("complete").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.command, r.n) for r in spark.sql("select * from counts").collect()) == [("c1", 2), ("c2", 1)]

    def prepare(batch):
        if batch.where("ok = 0").count():
            raise ValueError("bad input")
        return batch

    q = log.append_batches(stream(), str(tmp_path / "out"), str(tmp_path / "ck"), prepare, str(tmp_path / "dead")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "dead")).first().error == "bad input"


def test_even_choice_is_the_best_of_all(spark):
    rng = random.Random(3)
    for _ in range(150):
        x, least = sorted(float(rng.randrange(30)) for _ in range(rng.randint(1, 9))), float(rng.choice([1, 3, 7, 40]))
        fits = [c for n in range(1, len(x) + 1) for c in itertools.combinations(range(len(x)), n) if all(x[b] - x[a] >= least for a, b in zip(c, c[1:]))]
        most = max(map(len, fits))
        if most == 1:
            goal = [(x[0] + x[-1]) / 2]
        else:
            goal = [x[0] + (x[-1] - x[0]) * k / (most - 1) for k in range(most)]
        cost = lambda c: sum((x[i] - g) ** 2 for i, g in zip(c, goal))
        got = greedy._even_choice(greedy.np.array(x), least)
        assert len(got) == most and abs(cost(got) - min(cost(c) for c in fits if len(c) == most)) < 1e-9
    d = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate([0, 1, 5, 6, 10])] + [(1, 9, None)], "k int, id bigint, p double")
    assert [r.id for r in greedy.evenly_spaced(d, "k", "p", "id", 4.0).orderBy("rank").collect()] == [0, 2, 4]


def test_spaced_random_is_the_greedy_walk(spark):
    rng = random.Random(4)
    rows = [(i, rng.uniform(0, 10), rng.uniform(0, 10)) for i in range(80)]
    df = spark.createDataFrame(rows, "id bigint, y double, x double")
    order = [r.id for r in df.orderBy(expr.stable_hash("id", seed="q"), "id").collect()]
    taken = []
    for i in order:
        if all(math.dist(rows[i][1:], rows[j][1:]) >= 1.5 for j in taken):
            taken.append(i)
    assert {r.id for r in greedy.spaced_random(df, "id", ["y", "x"], 1.5, 100, "q").collect()} == set(taken)
    assert {r.id for r in greedy.spaced_random(df, "id", ["y", "x"], 1.5, 5, "q").collect()} == set(taken[:5])


def test_grid_unwrapping(spark):
    rows = [(i, j, 1.1 * i + 0.9 * j) for i in range(5) for j in range(6)] + [(20, 20, 1.0)]
    got = {(r.i, r.j): (r.turns, r.main) for r in greedy.unwrapped_grid(spark.createDataFrame(rows, "i int, j int, a double"), "i", "j", "a").collect()}
    # A jump of more than half a turn up means that the angle went down through 0.
    assert all(got[i, j] == (-int(a // (2 * math.pi)), True) for i, j, a in rows[:-1]) and got[20, 20] == (0, False)


def test_surfaces_and_reports(spark, tmp_path):
    for name, text in (("a", '{"format": "tifxyz", "uuid": "s1", "scale": [0.05, 0.05], "area_vx2": 7.5}'), ("b", '{"format": "other"}'), ("c", "{broken")):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "meta.json").write_text(text)
    got = sorted((r.name, r.area, r.bad) for r in files.surface_index(spark, str(tmp_path / "in")).collect())
    assert got == [("c", None, True), ("s1", 7.5, False)]
    files.write_report(spark.range(3).withColumn("t", F.lit("<b>")), str(tmp_path / "report"), "A & B")
    page = spark.read.text(str(tmp_path / "report")).first().value
    assert "<th>id</th>" in page and "&lt;b&gt;" in page and "A &amp; B" in page


def test_numbers_quantiles_and_sweeps_without_a_task_for_a_key(spark):
    """Against plain sorts; the plans deal no rows to a single task."""
    rng = random.Random(12)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(40), rng.choice([None, rng.uniform(0, 9), 4.0])) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, o bigint, v double").repartition(3)
    got = ragged.numbered_within(df, ["k"], ["o"], "n").collect()
    for k in ("a", "b", None):
        own = sorted((r.n, r.o) for r in got if r.k == k)
        assert [n for n, _ in own] == list(range(len(own))) and [o for _, o in own] == sorted(o for q, o, _ in rows if q == k)
    have = {r.k: r.q for r in aggs.exact_quantiles(df, ["k"], "v", 0.0, 1 / 3, 0.5, 1.0).collect()}
    for k in ("a", "b", None):
        v = np.array([x for q, _, x in rows if q == k and x is not None])
        assert np.allclose(have[k], np.quantile(v, [0, 1 / 3, 0.5, 1]))
    assert np.allclose(aggs.exact_quantiles(df, [], "v", 0.9).first().q, np.quantile([x for *_, x in rows if x is not None], 0.9))
    assert aggs.exact_quantiles(df.limit(0), ["k"], "v", 0.5).count() == 0
    spans = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), ("a", 3, 9), ("b", 0, 1), ("b", 7, 9), ("b", 8, 12)], "k string, lo int, hi int")
    assert sorted(map(tuple, joins.most_overlapped(spans, "k", "lo", "hi").collect())) == [("a", 2, 2), ("b", 8, 2)]
    # From 2 on, (1, 5) and (2, 3); from 3 on, (1, 5) and (3, 9); from 8 on, three: (3, 9), (7, 9) and (8, 12).
    assert tuple(joins.most_overlapped(spans, None, "lo", "hi").first()) == (8, 3)
    assert [r.o for r in sampling.systematic(df.select("o").distinct(), "o", 7).orderBy("o").collect()] == sorted({o for _, o, _ in rows})[::7]


def test_a_node_that_the_graph_lacks_is_an_error(spark):
    edges = spark.createDataFrame([(1, 2), (2, 5)], "a bigint, b bigint")
    known = spark.createDataFrame([(1,), (2,), (5,)], "n bigint")
    assert sorted(map(tuple, joins.restricted(edges, known.where("n > 1"), "n", known).collect())) == [(0, 1)]
    with pytest.raises(ValueError, match="not in the graph: 9"):
        joins.restricted(edges, spark.createDataFrame([(1,), (9,)], "n bigint"), "n", known)


def test_a_batch_that_fails_while_it_is_written_ends_the_stream(spark, tmp_path):
    """It is no bad input: the next run takes it again, and nothing is lost."""
    spark.createDataFrame([(1, "4"), (2, "x")], "k int, v string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("k int, v string").parquet(str(tmp_path / "in"))
    start = lambda prepare: log.append_batches(stream(), str(tmp_path / "out"), str(tmp_path / "mark"), prepare, str(tmp_path / "dead")).trigger(availableNow=True).start()
    late = lambda batch: batch.withColumn("n", F.when(F.col("v") == "x", F.raise_error(F.lit("a lost executor"))).otherwise(F.lit(1)))
    with pytest.raises(Exception, match="a lost executor"):
        start(late).awaitTermination()
    assert not (tmp_path / "dead").exists()
    start(lambda batch: batch).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_windings_come_by_their_circumference(spark):
    n = 20_000
    d = spark.range(n).select(expr.winding_by_circumference((F.col("id") + 0.5) / n, 2, 6).alias("k")).groupBy("k").count().collect()
    weight = {k: (k + 0.5) / sum(j + 0.5 for j in range(2, 7)) for k in range(2, 7)}
    assert {r.k for r in d} == set(weight) and all(abs(r["count"] / n - weight[r.k]) < 1e-3 for r in d)


def test_first_near_is_that_of_all_pairs(spark):
    rng = random.Random(12)
    left = [(k, rng.randint(0, 2), rng.choice([None, *(x / 2 for x in range(40))])) for k in range(120)]
    right = [(k, rng.randint(0, 2), rng.choice([None, *(x / 2 for x in range(40))])) for k in range(90)]
    a, b = spark.createDataFrame(left, "k int, kn int, x double"), spark.createDataFrame(right, "r int, rn int, y double")
    near = joins.first_near(a, b, "r", ("x", "y"), 2.0, ["distance", "r"], same=[("kn", "rn")])
    best = {k: min(((abs(x - y), r) for r, n, y in right if y is not None and n == kn and abs(x - y) <= 2), default=None) for k, kn, x in left if x is not None}
    assert {q.k: (q.distance, q.r) for q in near.collect()} == {k: v for k, v in best.items() if v}
    most = joins.first_near(a, b, "r", ("x", "y"), 2.0, [-F.col("y"), "distance", "r"])
    best = {k: min(((-y, abs(x - y), r) for r, _, y in right if y is not None and abs(x - y) <= 2), default=None) for k, _, x in left if x is not None}
    assert {q.k: (-q.y, q.distance, q.r) for q in most.collect()} == {k: v for k, v in best.items() if v}


@pytest.mark.parametrize("places", [1 << 14, 5])
def test_nearest_and_largest_are_searched_not_met_in_pairs(spark, monkeypatch, places):
    """Distances on the radius, some of them by rounding only, and different places at one rounded distance."""
    monkeypatch.setattr(joins, "PLACES", places)
    rng = random.Random(21)
    odd = [None, float("nan"), float("inf"), -0.0, 0.3, 0.1 + 0.2, -1e-17, 1e-17, 1.0, 2.0, 1.3, 49.99, 99.99]
    place = lambda: rng.choice([rng.choice(odd), rng.randint(-500, 500) / 100, rng.randint(-9, 9) / 2])
    left = [(k, rng.choice([None, 0, 1, 2]), place()) for k in range(200)]
    right = [(rng.choice([None, *range(60)]), rng.choice([None, 0, 1, 2]), place()) for k in range(120)]
    a, b = spark.createDataFrame(left, "k int, kn int, x double"), spark.createDataFrame(right, "r int, rn int, y double")
    last = lambda r: (r is None, r or 0)
    near = lambda x, y, radius: None not in (x, y) and abs(x - y) <= radius
    for radius in (0.5, 1.0, 2.0, 50.0):
        got = {q.k: (q.distance, q.r) for q in joins.nearest_within(a, b, "r", ("x", "y"), radius, same=[("kn", "rn")]).collect()}
        best = {k: min(((abs(x - y), last(r)) for r, n, y in right if n == kn and n is not None and near(x, y, radius)), default=None) for k, kn, x in left}
        assert {k: (d, last(r)) for k, (d, r) in got.items()} == {k: v for k, v in best.items() if v}
        got = {q.k: (-q.y, q.distance, last(q.r)) for q in joins.largest_within(a, b, "r", ("x", "y"), radius).collect()}
        best = {k: min(((-y, abs(x - y), last(r)) for r, _, y in right if near(x, y, radius)), default=None) for k, _, x in left}
        assert got == {k: v for k, v in best.items() if v}
    # No row is a pair of places: places of a cell meet as arrays, and distances are made in the search.
    plan = joins.nearest_within(a, b, "r", ("x", "y"), 2.0, same=[("kn", "rn")])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "SQRT" not in plan and "POWER" not in plan


def test_spaced_random_takes_up_some_points_at_a_time(spark, monkeypatch):
    rng = random.Random(13)
    rows = [(i, rng.choice([None, rng.uniform(0, 9)]) if i % 7 == 0 else rng.uniform(0, 9), rng.uniform(0, 9)) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, y double, x double").repartition(3)
    order = [r.id for r in df.orderBy(expr.stable_hash("id", seed="q"), "id").collect()]
    taken, at = [], {i: (y, x) for i, y, x in rows}
    for i in order:
        if at[i][0] is None or all(at[k][0] is None or math.dist(at[i], at[k]) >= 1.5 for k in taken):
            taken.append(i)
    monkeypatch.setattr(greedy, "AT_ONCE", 20)
    for count in (5, 100):
        assert [r.id for r in greedy.spaced_random(df, "id", ["y", "x"], 1.5, count, "q").collect()] == taken[:count]


def test_fibres_of_many_users_share_a_file(spark, tmp_path, monkeypatch):
    from datetime import datetime

    from spanloom.plans import stores

    rows = [(e, datetime(2024, 1, 1), e % 90, "view" if e % 3 else "click", float(e)) for e in range(600)]
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double")
    monkeypatch.setattr(stores, "_folder", lambda t: str(tmp_path / "f"))
    got = {(r.name, r.tag): (r.points, r.z) for r in stores.fibre_files(lambda name: events).collect()}
    want = {}
    for e, _, u, kind, v in rows:
        n, z = want.get((f"u{u}", kind), (0, 0.0))
        want[f"u{u}", kind] = (n + 1, z + v * 0.25)
    assert got == want and len(list((tmp_path / "f").rglob("*.txt"))) == 2
