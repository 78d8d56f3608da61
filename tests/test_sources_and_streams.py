import json
import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from calibra.functions.text import tenths
from calibra.models import continuous
from calibra.models.count import CountBank, conservative, randomised
from calibra.plans import streams
from calibra.sources import payloads as p
from calibra.streaming import live

OBS = "stream_id string, cell string, ts long, value double, first_seen long"


def bodies(spark, *docs):
    return spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in docs], "body string")


def test_records_filter_and_convert(spark):
    docs = bodies(spark, {"items": [{"id": "a", "t": 5.9, "v": {"x": "3"}, "k": "y"}, {"id": "b", "t": 6, "v": {"x": "no"}, "k": "y"}, {"id": "c", "t": 6, "v": {"x": 9}, "k": "n"}]}, "not json", {"other": 1})
    assert [tuple(r) for r in p.records(docs, "s", "items", "id", ("t", "epoch"), "v.x", {"k": ["y"]}).collect()] == [("s", "a", 5, 3.0)]
    assert p.records(docs, "s", "items", "id", ("t", "epoch"), None).count() == 3


def test_parallel_arrays_are_strict(spark):
    docs = bodies(spark, {"t": ["2024-01-01T00:00:00Z", "2024-01-01T01:00:00Z"], "v": ["1", "2"]}, {"t": ["2024-01-01T00:00:00Z"], "v": []})
    assert [tuple(r) for r in p.parallel_series(docs, "s", "c", "t", "v", "yyyy-MM-dd'T'HH:mm:ssX").collect()] == [("s", "c", 1704067200, 1.0)]


def test_alert_protocol(spark):
    xml = "<alert><identifier>1</identifier><sent>2024-01-01T00:00:00+00:00</sent><status>{}</status><msgType>Alert</msgType><info><language>fr</language><severity>Minor</severity><area><areaDesc>F</areaDesc></area></info><info><language>en-GB</language><severity>Severe</severity><area><areaDesc>A</areaDesc></area><area><areaDesc>B</areaDesc></area></info></alert>"
    got = p.cap_alerts(bodies(spark, xml.format("Actual"), xml.format("Test")), "s").collect()
    assert sorted((r.cell, r.ts, r.value) for r in got) == [("A", 1704067200, 3.0), ("B", 1704067200, 3.0)]


def test_status_page_squawks_and_views(spark):
    page = {"components": [{"name": "Paris (CDG)", "status": "down", "updated_at": "2024-01-01T00:00:00Z", "group": False}, {"name": "All", "status": "down", "updated_at": "2024-01-01T00:00:00Z", "group": True}, {"name": "X", "status": "operational", "updated_at": "2024-01-01T00:00:00Z"}]}
    assert [r.cell for r in p.components(bodies(spark, page), "s").collect()] == ["CDG"]
    sky = {"now": 1704067200000, "ac": [{"hex": "a", "squawk": "7700", "lat": 1.0, "lon": 2.0}, {"hex": "a", "squawk": "7700", "lat": 1.0, "lon": 2.0}, {"hex": "b", "squawk": "1000", "lat": 1, "lon": 2}]}
    assert p.squawks(bodies(spark, sky), "s", lambda lat, lon: lat.cast("string")).count() == 1
    views = spark.createDataFrame([("x/pageviews-20240101-010000", "en A 1 0\nen.m B 2 0\nde C 4 0\nbad")], "url string, body string")
    assert sorted((r.cell, r.ts, r.value) for r in p.project_views(views, "s").collect()) == [("de", 1704070800, 4.0), ("en", 1704070800, 3.0)]


def test_tenths_rounds_the_exact_value(spark):
    xs = [i / 100 for i in range(-999, 1000)] + [4.55, 0.25, 0.35, 1234.45]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", tenths(F.col("x")).alias("y")).collect()
    assert all(r.y == round(r.x, 1) for r in got)


def file_stream(spark, folder, rows, files=1):
    for i, part in enumerate(np.array_split(np.arange(len(rows)), files)):
        before = set(folder.glob("*.parquet"))
        spark.createDataFrame([rows[j] for j in part], OBS).coalesce(1).write.mode("append").parquet(str(folder))
        for f in set(folder.glob("*.parquet")) - before:  # the source reads files by time
            os.utime(f, (1_700_000_000 + 10 * i,) * 2)
    return spark.readStream.schema(OBS).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_point_scores_go_on_over_batches(spark, tmp_path):
    rows = [("s", "c", 60 * i, float(i % 7), 60 * i) for i in range(40)] + [("s", "c", 60, 1.0, 9000)]
    got = streams.run(live.score_points(file_stream(spark, tmp_path / "in", rows, 3))).toPandas()
    state, want = continuous.ContinuousState(), []
    for r in rows[:-1]:
        state, q, _ = continuous.step(state, continuous.ContinuousParams(), r[2], r[3])
        want.append(q)
    scored = got.dropna(subset=["q_value"]).sort_values("bin_start")
    assert len(got) == 41 and np.allclose(scored.q_value, want)


def test_count_scores_close_quiet_windows(spark, tmp_path):
    seen, base = [1_000_000 + t for t in (0, 10, 100, 400, 1000)], 1_000_000  # time 0 is at the first watermark, so late
    rows = [("s", "c", t, 1.0, t) for t in seen] + [("s", "d", base + 2000, 1.0, base + 2000)]
    got = streams.run(live.score_counts(file_stream(spark, tmp_path / "in", rows, 2), 100)).toPandas()
    own = got[got.cell == "c"].sort_values("bin_start")
    bank, want = CountBank(1), []
    for start in own.bin_start.tolist():
        lo, hi = bank.step(start, np.array([sum(t // 100 * 100 == start for t in seen)]), 100)
        want.append(float(conservative(lo, hi)[0]))
    assert own.bin_start.tolist() == list(range(base, own.bin_start.max() + 1, 100)) and own.bin_start.max() >= base + 400
    assert np.allclose(own.q_detect, want)


def test_keys_count_once_and_archive_stays(spark, tmp_path):
    rows = [("s", "c", i % 5, 1.0, i) for i in range(20)]
    live.into_archive(live.once(file_stream(spark, tmp_path / "in", rows, 2)), str(tmp_path / "out"), str(tmp_path / "state"), ["stream_id", "cell", "ts"]).awaitTermination()
    assert sorted(r.ts for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 3, 4]


def test_randomised_quantile_lies_between():
    lo, hi = np.array([0.1, 0.9]), np.array([0.2, 1.0])
    q = randomised(lo, hi, np.array([1, 2], np.uint64), np.array([3, 3]))
    assert ((q >= lo) & (q <= hi)).all() and isinstance(pd.Series(q).sum(), float)
