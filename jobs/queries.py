"""The jobs as queries: each runs its job twice into one new folder and returns the output as it stands then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spanloom.operators.graph import shared_folder

from . import shared_lines, track_volume


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "job1")
    for _ in range(2):
        shared_lines.run(spark, f"{sf_dir}/documents.parquet", out, f"{out}/checkpoint")
    return shared_lines.current(spark, out)


def job2_track_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "job2")
    for _ in range(2):
        track_volume.run(spark, f"{sf_dir}/lineitem.parquet", out)
    return track_volume.volume(spark, out).select("z", "y", "x", "label", "track", "tracks")


def _shared_lines_sql() -> str:
    least = shared_lines.configured()["least_words"]
    return f"""WITH d AS (SELECT doc_id, lang, source, list_filter(list_transform(string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)),
  lambda s: trim(regexp_replace(s, '[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g'), ' ')), lambda s: s <> '' AND len(string_split(s, ' ')) >= {least}) AS cells
  FROM (SELECT doc_id, unnest(min(struct_pack(text := text, lang := lang, source := source))) FROM documents WHERE doc_id IS NOT NULL GROUP BY 1)),
p AS (SELECT doc_id, unnest(generate_series(0, len(cells) - 1)) AS pos, unnest(cells) AS cell FROM d),
s AS (SELECT cell FROM p GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
q AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM p WHERE cell IN (SELECT cell FROM s)),
r AS (SELECT doc_id, run, min(pos) AS start, count(*) AS length FROM q GROUP BY 1, 2),
b AS (SELECT doc_id, arg_min(start, (-length, start)) AS run_start, max(length) AS run_length, CAST(sum(length) AS BIGINT) AS n_shared FROM r GROUP BY 1)
SELECT d.doc_id, lang, source, CAST(len(cells) AS BIGINT) AS n_lines, coalesce(n_shared, 0) AS n_shared, run_start, coalesce(run_length, 0) AS run_length FROM d LEFT JOIN b ON b.doc_id = d.doc_id"""


def _track_volume_sql() -> str:
    config = track_volume.configured()
    z, y, x = config["voxel"]
    to = lambda a: f"CAST(round_even(CASE WHEN k = 0 THEN p{a} ELSE p{a} + ({a} - p{a}) * k / n END, 0) AS BIGINT) AS {a}"
    return f"""WITH p AS (SELECT l_orderkey AS track, l_linenumber AS pos, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) / {z} AS z, CAST(l_quantity AS DOUBLE) / {y} AS y, CAST(l_discount * 100 AS DOUBLE) / {x} AS x FROM lineitem),
s AS (SELECT track, z, y, x, coalesce(lag(z) OVER w, z) AS pz, coalesce(lag(y) OVER w, y) AS py, coalesce(lag(x) OVER w, x) AS px FROM p WHERE track IS NOT NULL AND pos IS NOT NULL AND z IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL WINDOW w AS (PARTITION BY track ORDER BY pos, z, y, x)),
n AS (SELECT *, CAST(ceil(greatest(abs(z - pz), abs(y - py), abs(x - px))) AS BIGINT) AS n FROM s), k AS (SELECT *, unnest(generate_series(0, n)) AS k FROM n),
v AS (SELECT DISTINCT track, {to("z")}, {to("y")}, {to("x")} FROM k)
SELECT z, y, x, 1 + min(track) % {config["labels"]} AS label, min(track) AS track, count(*) AS tracks FROM v GROUP BY z, y, x"""


QUERIES = {"job1_shared_lines": job1_shared_lines, "job2_track_volume": job2_track_volume}
ORACLES = {"job1_shared_lines": _shared_lines_sql(), "job2_track_volume": _track_volume_sql()}
