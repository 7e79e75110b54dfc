"""The jobs over growing and changing input, against plain forms."""

import json
import logging
import random
import re
from datetime import date, timedelta

import duckdb
import pandas as pd
import numpy as np
import pytest

from jobs import queries, shared_lines, track_volume
from jobs.shared_lines import Batches

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- shared lines


def plain_lines(docs, least=3):
    """doc_id -> (n_lines, n_shared, run_start, run_length)."""
    cells, seen = {}, {}
    for doc, text in docs.items():
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        lines = [re.sub(r"[\x20\x09\x0B-\x0D]+", " ", s).strip(" ") for s in lower.split("\n")]
        cells[doc] = [s for s in lines if s and len(s.split(" ")) >= least]
        for s in set(cells[doc]):
            seen.setdefault(s, set()).add(doc)
    out = {}
    for doc, own in cells.items():
        on = [len(seen[s]) > 1 for s in own]
        best, start, i = 0, None, 0
        while i < len(on):
            j = i
            while j < len(on) and on[j]:
                j += 1
            if j - i > best:
                best, start = j - i, i
            i = max(j, i + 1)
        out[doc] = (len(own), sum(on), start, best)
    return out


def documents(seed, ids):
    rng = random.Random(seed)
    pool = [f"Line number {k} of the pool" for k in range(12)] + ["too short", "", "  a  line\twith   spaces  ", "A line with SPACES"]
    docs = {i: "\n".join(rng.choice([*pool, f"own words of {i} {rng.random()}"]) for _ in range(rng.randint(0, 9))) for i in ids}
    return docs


def put(spark, folder, rows, name):
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, source string, text string")
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def got(spark, out):
    return {r.doc_id: (r.n_lines, r.n_shared, r.run_start, r.run_length) for r in shared_lines.current(spark, out).collect()}


CONFIG = {"least_words": 3, "files_per_batch": 1, "buckets": 4}


def arrive(spark, folder, docs, k, more=()):
    rows = [(i, "en", None, t) for i, t in docs.items()] + list(more)
    spark.createDataFrame(rows, "doc_id bigint, lang string, source string, text string").coalesce(1).write.mode("append").parquet(folder)


def test_two_runs_over_growing_input(spark, tmp_path, caplog):
    folder, out, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))
    first, second = documents(1, range(0, 40)), documents(2, range(40, 70))
    arrive(spark, folder, first, 0)
    with caplog.at_level(logging.INFO):
        wrote = shared_lines.run(spark, folder, out, mark, CONFIG)
    assert [w["documents"] for w in wrote] == [40] and got(spark, out) == plain_lines(first)
    assert "40 new documents" in caplog.text
    assert shared_lines.run(spark, folder, out, mark, CONFIG) == [] and got(spark, out) == plain_lines(first)
    arrive(spark, folder, second, 1)
    wrote = shared_lines.run(spark, folder, out, mark, CONFIG)
    # Only what is new is taken, and old documents that now share more are brought up to date.
    assert [w["documents"] for w in wrote] == [30] and wrote[0]["tracks"] >= 30
    assert got(spark, out) == plain_lines({**first, **second})
    whole = f"{tmp_path}/whole"
    shared_lines.run(spark, folder, whole, f"{whole}-mark", {**CONFIG, "files_per_batch": 100})
    assert got(spark, whole) == got(spark, out)


def test_ids_that_come_again_nulls_and_no_lines(spark, tmp_path):
    folder, out, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))
    arrive(spark, folder, {1: "one two three\nfour five six", 2: "one two three", 3: None, 4: ""}, 0, [(None, "en", "x", "one two three"), (2, "en", "x", "zzz zzz zzz")])
    shared_lines.run(spark, folder, out, mark, CONFIG)
    arrive(spark, folder, {1: "another text of id one", 5: "four five six"}, 1)
    shared_lines.run(spark, folder, out, mark, CONFIG)
    assert got(spark, out) == plain_lines({1: "one two three\nfour five six", 2: "one two three", 3: None, 4: "", 5: "four five six"})


def test_a_batch_that_broke_off_is_made_again(spark, tmp_path, monkeypatch):
    folder, out, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))
    first, second = documents(3, range(20)), documents(4, range(20, 35))
    arrive(spark, folder, first, 0)
    shared_lines.run(spark, folder, out, mark, CONFIG)
    arrive(spark, folder, second, 1)
    write = Batches._write

    def broken(self, rows, name, *rest):
        if name == "tracks":
            raise OSError("no space left")
        return write(self, rows, name, *rest)

    monkeypatch.setattr(Batches, "_write", broken)
    with pytest.raises(Exception, match="no space left"):
        shared_lines.run(spark, folder, out, mark, CONFIG)
    monkeypatch.setattr(Batches, "_write", write)
    wrote = shared_lines.run(spark, folder, out, mark, CONFIG)
    assert [w["documents"] for w in wrote] == [15]
    assert got(spark, out) == plain_lines({**first, **second})


def test_output_without_its_checkpoint_is_refused(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    arrive(spark, folder, documents(5, range(5)), 0)
    shared_lines.run(spark, folder, out, f"{tmp_path}/mark", CONFIG)
    with pytest.raises(ValueError, match="knows nothing"):
        shared_lines.run(spark, folder, out, f"{tmp_path}/other", CONFIG)


# ---------------------------------------------------------------- track volume

VOLUME = {"voxel": [4.0, 2.0, 1.0], "slab": 8, "labels": 7}
LINES = "l_orderkey bigint, l_linenumber bigint, l_shipdate date, l_quantity double, l_discount double, other string"


def order_lines(seed, orders):
    rng = random.Random(seed)
    return [(o, k, date(1995, 1, 1) + timedelta(rng.randint(0, 700)), float(rng.randint(1, 50)), rng.randint(0, 10) / 100, "x") for o in orders for k in range(1, rng.randint(2, 6))]


def plain_volume(rows, config):
    """(z, y, x) -> (label, track, tracks), by plain interpolation."""
    tracks, cells = {}, {}
    for o, k, d, q, c, _ in rows:
        if None not in (o, k, d, q, c):
            at = ((d - date(1970, 1, 1)).days / config["voxel"][0], q / config["voxel"][1], c * 100 / config["voxel"][2])
            tracks.setdefault(o, []).append((k, *at))
    for o, points in tracks.items():
        points = [p[1:] for p in sorted(points)]
        for a, b in zip([points[0], *points], points):
            n = max(-int(-abs(y - x) // 1) for x, y in zip(a, b))
            for k in range(n + 1):
                cells.setdefault(tuple(round(x + (y - x) * k / n) if k else round(x) for x, y in zip(a, b)), set()).add(o)
    return {v: (1 + min(t) % config["labels"], min(t), len(t)) for v, t in cells.items()}


def voxels(spark, out):
    return {(r.z, r.y, r.x): (r.label, r.track, r.tracks) for r in track_volume.volume(spark, out).collect()}


def lines_at(spark, rows, path):
    spark.createDataFrame(rows, LINES).coalesce(2).write.mode("overwrite").parquet(path)
    return path


def test_a_volume_and_its_rerun(spark, tmp_path):
    rows = [*order_lines(1, range(1, 40)), (90, 1, None, 1.0, 0.1, "x"), (None, 1, date(1995, 1, 1), 1.0, 0.1, "x")]
    path, out = lines_at(spark, rows, f"{tmp_path}/lines"), f"{tmp_path}/out"
    done = track_volume.run(spark, path, out, VOLUME)
    want = plain_volume(rows, VOLUME)
    assert voxels(spark, out) == want and done["made"] == done["slabs"] > 3 and done["voxels"] == len(want)
    assert track_volume.run(spark, path, out, VOLUME) == {"slabs": done["slabs"], "made": 0, "voxels": 0}
    assert voxels(spark, out) == want


def test_only_slabs_that_changed_are_made_again(spark, tmp_path):
    rows, out = order_lines(2, range(1, 40)), f"{tmp_path}/out"
    first = track_volume.run(spark, lines_at(spark, rows, f"{tmp_path}/a"), out, VOLUME)
    early = [(500, 1, date(1995, 1, 3), 40.0, 0.05, "x"), (500, 2, date(1995, 1, 9), 10.0, 0.0, "x")]
    second = track_volume.run(spark, lines_at(spark, rows + early, f"{tmp_path}/b"), out, VOLUME)
    assert second["made"] == 1 < first["slabs"] and voxels(spark, out) == plain_volume(rows + early, VOLUME)
    fewer = [r for r in rows if r[0] > 3]
    track_volume.run(spark, lines_at(spark, fewer, f"{tmp_path}/c"), out, VOLUME)
    assert voxels(spark, out) == plain_volume(fewer, VOLUME)
    other = {**VOLUME, "labels": 3}
    assert track_volume.run(spark, f"{tmp_path}/c", out, other)["made"] == track_volume.run(spark, f"{tmp_path}/c", f"{tmp_path}/new", other)["slabs"]
    assert voxels(spark, out) == plain_volume(fewer, other)


def test_slabs_without_input_go(spark, tmp_path):
    rows, out = order_lines(3, range(1, 20)), f"{tmp_path}/out"
    late = [(900, 1, date(2020, 1, 1), 5.0, 0.0, "x")]
    track_volume.run(spark, lines_at(spark, rows + late, f"{tmp_path}/a"), out, VOLUME)
    done = track_volume.run(spark, lines_at(spark, rows, f"{tmp_path}/b"), out, VOLUME)
    assert done["made"] == 1 and done["voxels"] == 0 and voxels(spark, out) == plain_volume(rows, VOLUME)
    assert track_volume.run(spark, f"{tmp_path}/b", out, VOLUME)["made"] == 0


def test_a_run_over_some_slabs_and_one_that_broke_off(spark, tmp_path, monkeypatch):
    rows, out = order_lines(4, range(1, 30)), f"{tmp_path}/out"
    path, want = lines_at(spark, rows, f"{tmp_path}/a"), plain_volume(rows, VOLUME)
    lo = min(v[0] for v in want) // 8
    some = track_volume.run(spark, path, out, VOLUME, (lo, lo + 2))
    assert some["made"] == 2 and voxels(spark, out) == {v: w for v, w in want.items() if lo <= v[0] // 8 < lo + 2}
    write = track_volume._overwrite

    def broken(df, to):
        if to.endswith("ledger"):
            raise OSError("lost")
        write(df, to)

    monkeypatch.setattr(track_volume, "_overwrite", broken)
    with pytest.raises(OSError):
        track_volume.run(spark, path, out, VOLUME)
    monkeypatch.setattr(track_volume, "_overwrite", write)
    track_volume.run(spark, path, out, VOLUME)
    assert voxels(spark, out) == want


def test_an_empty_table(spark, tmp_path):
    path, out = lines_at(spark, [], f"{tmp_path}/a"), f"{tmp_path}/out"
    assert track_volume.run(spark, path, out, VOLUME)["made"] == 0 and voxels(spark, out) == {}


# ---------------------------------------------------------------- queries and command lines


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "lineitem"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    have, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    columns = sorted(have.columns)
    assert columns == sorted(want.columns) and len(want) > 100
    plain = lambda df: sorted(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).astype(str).replace(r"\.0$", "", regex=True).to_numpy().tolist()))
    assert plain(pd.DataFrame(have)) == plain(want)
    assert before == {k: spark.conf.get(k, None) for k in before}


def test_config_files_are_complete():
    assert set(shared_lines.configured()) == set(CONFIG) and set(track_volume.configured()) == set(VOLUME)
    assert json.loads(shared_lines.CONFIG.read_text())["least_words"] >= 1


@pytest.mark.parametrize(("job", "options"), [(shared_lines, ["--documents", "d", "--out", "o", "--checkpoint", "c"]), (track_volume, ["--lines", "l", "--out", "o", "--slabs", "1", "3"])])
def test_command_lines_run_the_job_and_stop_their_session(monkeypatch, job, options):
    calls = []

    class Session:
        def appName(self, name):
            return self

        def getOrCreate(self):
            return self

        def stop(self):
            calls.append("stopped")

    monkeypatch.setattr(job, "SparkSession", type("S", (), {"builder": Session()}))
    monkeypatch.setattr(job, "run", lambda spark, *args: calls.append(args))
    monkeypatch.setattr("sys.argv", ["job", *options])
    job.main()
    assert calls[-1] == "stopped" and calls[0][:2] == tuple(options[1:4:2]) and job.configured() in calls[0]


def test_voxels_are_counted_before_they_are_shuffled(spark, monkeypatch):
    rows = order_lines(6, range(1, 60))
    p = track_volume.points(spark.createDataFrame(rows, LINES), VOLUME)
    monkeypatch.setattr(track_volume, "AT_ONCE", 300)
    got = track_volume.voxels(track_volume.segments(p), VOLUME)
    assert {(r.z, r.y, r.x): (r.label, r.track, r.tracks) for r in got.collect()} == plain_volume(rows, VOLUME)
    # No exchange by track and voxel: a track's voxels are many times its segments.
    plan = got._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert dealt and not [line for line in dealt if "track" in line and "z#" in line.split("hashpartitioning(")[1].split("]")[0]]


def test_distinct_rows_of_any_range():
    columns = [np.array([1, 1, -(2**62), 1]), np.array([5, 5, 2**61, 4]), np.array([0, 0, 7, 2**60])]
    assert [c.tolist() for c in track_volume._distinct(columns)] == [[-(2**62), 1, 1], [2**61, 4, 5], [7, 2**60, 0]]


def plain_counts(segments):
    """(z, y, x) -> (least track, tracks) of rows track, p_z, p_y, p_x, z, y, x, n."""
    cells = {}
    for track, *ends, n in segments:
        for k in range(n + 1):
            cells.setdefault(tuple(round(x + (y - x) * k / n) if k else round(x) for x, y in zip(ends[:3], ends[3:])), set()).add(track)
    return {v: (min(t), len(t)) for v, t in cells.items()}


@pytest.mark.parametrize("far", [0.0, 2.0**46, 2.0**50])
def test_tracks_go_on_over_batches_and_a_task_has_one_row_for_a_voxel(monkeypatch, far):
    rng = random.Random(7)
    for name, value in (("AT_ONCE", 60), ("BLOCK", 16), ("HELD", 1 << 20)):
        monkeypatch.setattr(track_volume, name, value)
    rows = []
    for track in rng.sample(range(-50, 50), 40):
        points = [(far + rng.randint(-40, 40) / 4, rng.randint(-9, 9) / 2, float(rng.randint(0, 3))) for _ in range(rng.randint(1, 9))]
        rows += [(track, *a, *b, max(-int(-abs(y - x) // 1) for x, y in zip(a, b))) for a, b in zip([points[0], *points], points)]
    first = [k == 0 or rows[k][0] != rows[k - 1][0] for k in range(len(rows))]
    columns = [np.array(c) for c in zip(*rows)]
    names = ["track", "p_z", "p_y", "p_x", "z", "y", "x", "n", "first"]
    batches = [track_volume.pa.RecordBatch.from_arrays([track_volume.pa.array(c[k : k + 4]) for c in (*columns, np.array(first))], names=names) for k in range(0, len(rows), 4)]
    got = [r for b in track_volume._crossed(iter(batches)) for r in zip(*[c.to_pylist() for c in b.columns])]
    want = plain_counts(rows)
    assert len(got) == len(want) and {r[:3]: r[3:] for r in got} == want
    # Handed on early, voxels come more than once, and still add up.
    monkeypatch.setattr(track_volume, "HELD", 10)
    summed = {}
    for b in track_volume._crossed(iter(batches)):
        for z, y, x, track, n in zip(*[c.to_pylist() for c in b.columns]):
            least, tracks = summed.get((z, y, x), (track, 0))
            summed[z, y, x] = (min(least, track), tracks + n)
    assert summed == want


def test_segments_are_counted_before_they_are_dealt_to_slabs(spark):
    s = track_volume.segments(track_volume.points(spark.createDataFrame(order_lines(8, range(1, 30)), LINES), VOLUME))
    got = track_volume.inputs(s, VOLUME)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.index("Generate") < plan.rindex("HashAggregate")
    touched = {}
    for r in s.collect():
        for slab in range(round(min(r.z, r.p_z)) // 8, round(max(r.z, r.p_z)) // 8 + 1):
            touched[slab] = touched.get(slab, 0) + 1
    assert {r.slab: r.segments for r in got.collect()} == touched
