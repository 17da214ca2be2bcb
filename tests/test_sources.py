import json
import math

import duckdb
import pytest

from waymark.operators import correction, elevation, faults, ingestion, motion, sampling, temporal
from waymark.plans import binding
from waymark.sources import documents, gpx, synthetic
from pyspark.sql import functions as F

#: One point of every kind of defect; the second segment is empty.
MIXED = """<?xml version="1.1"?>
<gpx xmlns="http://www.topografix.com/GPX/1/1"><wpt lat="1" lon="2"><name> Hut </name><time>2024-01-01T00:00:00Z</time></wpt>
<rte><name>r</name><rtept lat="91" lon="0"><ele>5</ele></rtept></rte>
<trk><trkseg>
<trkpt lat="47.0" lon="8.0"><ele>500</ele><time>2024-01-01T10:00:00Z</time></trkpt>
<trkpt lat="47.001" lon="8.0"><ele>500</ele><time>2024-01-01T10:00:10Z</time></trkpt>
<trkpt lat="47.002" lon="8.0"><ele>high</ele><time>2024-01-01T10:00:10Z</time></trkpt>
<trkpt lat="x" lon="8.0"/>
<trkpt lat="47.003" lon="8.0"><ele>99999</ele><time>  </time></trkpt>
<trkpt lat="-90.5" lon="8.0"/>
<trkpt lat="47.004" lon="8.0"><time>2024-01-01T10:00:05Z</time></trkpt>
<trkpt lat="47.005" lon="8.0"/>
</trkseg><trkseg/></trk></gpx>"""


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.createDataFrame([("a", MIXED.replace('<?xml version="1.1"?>', "")), ("bad", "<gpx><trk>"), ("none", None)], "track_id string, gpx string")
    return gpx.parse(docs).persist()


def test_scan(rows):
    assert {r.kind: r["count"] for r in rows.groupBy("kind").count().collect()} == {"wpt": 1, "rte": 1, "rtept": 1, "trkseg": 2, "trkpt": 8, "error": 2}
    assert {r.track_id for r in gpx.errors(rows).collect()} == {"bad", "none"}
    assert [r.name for r in rows.filter("kind = 'wpt'").collect()] == ["Hut"]


def test_reference_points_keep_bad_coordinates(rows):
    got = {r.kind: (r.coords_valid, r.lat) for r in gpx.reference_points(rows).collect()}
    assert got == {"wpt": (True, 1.0), "rtept": (False, None)}
    assert len(gpx.routes(rows).first().points) == 1


def test_labels_of_a_document(rows):
    raw = gpx.raw_points(rows)
    pts = ingestion.accepted(raw)
    whole = ingestion.counts(raw, gpx.structure(rows)).first().asDict()  # the empty segment counts
    assert whole == {"track_id": "a", "total": 8, "valid": 6, "rejected": 2, "segments": 2, "waypoints": 1, "routes": 1, "has_any_time": True, "has_waypoints": True, "has_routes": True, "multi_segment": True}
    assert ingestion.counts(raw).first().segments == 1  # points alone don't tell of it
    parts = {r.trk_seg_index: r for r in ingestion.segment_summaries(raw, gpx.structure(rows)).collect()}
    assert (parts[0].point_count, parts[0].usable_time_count, parts[1].point_count, parts[1].usable_time_count, parts[1].first_ms) == (8, 4, 0, 0, None)
    times = {r.trk_seg_index: r.times for r in ingestion.segment_times(raw, gpx.structure(rows)).collect()}
    assert [t - times[0][0] for t in times[0]] == [0, 10_000, 10_000, 5_000] and times[1] == []
    assert {(r.gpx_index, r.reason_code) for r in ingestion.rejections(raw).collect()} == {(3, "not_a_number"), (5, "out_of_range")}
    assert "not parseable" in raw.filter("gpx_index = 3").select(gpx.rejection_text().alias("x")).first().x
    tags = {(r.tag, r.gpx_index) for r in temporal.tag_index(temporal.labels(pts)).collect()}
    assert tags == {("missing", 7), ("unparsable", 4), ("adjacent_duplicate", 2), ("below_anchor", 6)}
    ele = {(r.gpx_index, t) for r in elevation.labels(pts).collect() for t in elevation.TAGS if r[t]}
    assert ele == {(1, "ele_adjacent_duplicate"), (2, "ele_unparsable"), (4, "ele_out_of_bounds"), (6, "ele_missing"), (7, "ele_missing")}
    steps = sampling.edges(pts)
    assert {(r.from_gpx, r.to_gpx) for r in steps.collect()} == {(0, 1), (1, 2), (6, 7)}
    flags = motion.tag_counts(motion.pair_flags(steps)).first()
    assert (flags.pairs, flags.zero_time_delta, flags.time_unresolvable, flags.backward_time, flags.ele_unresolvable) == (3, 1, 1, 0, 2)


def test_files(spark, tmp_path):
    (tmp_path / "one.gpx").write_text("<gpx/>")
    (tmp_path / "other.txt").write_text("no")
    assert [tuple(r) for r in gpx.read_directory(spark, str(tmp_path)).collect()] == [("one", "<gpx/>")]
    (tmp_path / "c.csv").write_text('_id,name,gpx\nt1,"A ""b""","<gpx>\n</gpx>"\n,none,<gpx/>\nt3,empty,\n')
    got = {r.track_id: r.gpx for r in gpx.read_csv(spark, str(tmp_path / "c.csv")).collect()}
    assert got == {"t1": "<gpx>\n</gpx>", "row-2": "<gpx/>"}  # the place among all rows, from 1
    (tmp_path / "d.csv").write_text('_id,name,gpx\n,empty,\n,none,<gpx/>\n')
    both = {r.track_id for r in gpx.read_csv(spark, [str(tmp_path / "c.csv"), str(tmp_path / "d.csv")]).collect()}
    assert both == {"t1", "row-2"}
    assert gpx.page(gpx.read_csv(spark, str(tmp_path / "c.csv")), 1, 5).count() == 1


def test_an_empty_segment_parts_its_neighbours(spark):
    point = '<trkpt lat="47" lon="8"><time>2024-01-01T{}:00:00Z</time></trkpt>'
    body = "<gpx><trk><trkseg>" + point.format("10") + "</trkseg>{}<trkseg>" + point.format("12") + "</trkseg></trk></gpx>"
    found = {}
    for name, between in (("beside", ""), ("apart", "<trkseg/>")):
        rows = gpx.parse(spark.createDataFrame([(name, body.format(between))], "track_id string, gpx string"))
        found[name] = faults.inter_segment(ingestion.segment_summaries(gpx.raw_points(rows), gpx.structure(rows))).count()
    assert found == {"beside": 1, "apart": 0}


def test_implied_speed_is_rounded_as_in_sql(spark):
    pairs = [(gap, m) for gap in (*range(6_000_000, 43_000_000, 6_000_000), 21_600_000) for m in range(0, 3000, 50)]
    rows = [(t, 0, seg, seg * gap, seg * gap, lat, 0.0, lat, 0.0) for t, (gap, m) in enumerate(pairs) for seg, lat in ((0, 0.0), (1, math.degrees(m / 6_371_000)))]
    summaries = spark.createDataFrame(rows, "track_id long, track_index int, trk_seg_index int, first_ms long, last_ms long, first_lat double, first_lon double, last_lat double, last_lon double")
    got = {(r.gap_ms, r.implied_m): r.implied_kph for r in faults.inter_segment(summaries).collect()}
    sql = "select round(m / 1000 / (gap / 3600000.0), 1) from (select ?::bigint as gap, ?::double as m)"
    assert got == {p: duckdb.execute(sql, p).fetchone()[0] for p in pairs} and got[6_000_000, 750] == 0.5


def test_all_faults_have_the_same_speed(spark):
    points = [(1, g, g, 0, math.degrees(750 * g / 6_371_000), 0.0, 0.0, False, False, 6_000_000 * g) for g in (0, 1)]
    raw = spark.createDataFrame(points, "track_id long, gpx_index long, trk_seg_index int, track_index int, lat double, lon double, ele double, ele_absent boolean, time_absent boolean, time_ms long")
    assert [(r.type, r.implied_m, r.implied_kph) for r in faults.all_faults(raw, ingestion.segment_summaries(raw)).collect()] == [("missing_chunk_fault", 750.0, 0.5)]


def test_documents_round_trip(spark, sf_dir, tmp_path):
    raw = binding.raw_points(spark, sf_dir)
    docs = documents.audit_documents(raw).persist()
    assert docs.count() == 15
    one = json.loads(docs.orderBy("track_id").first().document)
    assert one["metadata"]["schema_version"] == "2.0.0" and set(one["audit"]) == {"ingestion", "temporal", "sampling", "motion", "elevation"}
    assert one["audit"]["temporal"]["counts"]["missing"] == len(one["audit"]["temporal"]["tag_index"]["missing"])
    assert one["metadata"]["summary"]["total_point_count"] == one["audit"]["ingestion"]["counts"]["total"] and one["metadata"]["generated_at_utc"].endswith("Z")
    assert set(one["audit"]["ingestion"]["context"]) == {"has_any_time", "has_waypoints", "has_routes", "multi_segment"}
    alike = spark.createDataFrame([("a/b", "1"), ("a_b", "2"), ("a b", "3")], "track_id string, document string")
    documents.write_documents(alike, str(tmp_path / "alike"), buckets=2)
    assert {r.track_id: r.value for r in documents.read_documents(spark, str(tmp_path / "alike")).collect()} == {"a/b": "1", "a_b": "2", "a b": "3"}
    assert documents.read_documents(spark, str(tmp_path / "alike")).select("name").distinct().count() == 3 and len(list((tmp_path / "alike").glob("bucket=*"))) <= 2
    documents.write_documents(docs, str(tmp_path / "audit"))
    assert documents.read_documents(spark, str(tmp_path / "audit")).count() == 15
    log = correction.correct(raw).persist()
    fixed = [json.loads(r.document) for r in documents.correction_documents(log, ingestion.accepted(raw)).collect()]
    assert all(d["participation"]["mode"] and d["spine_intervals"] and d["segment_profiles"] for d in fixed)
    assert any(d.get("boundary_classes") for d in fixed) and any(d.get("staged_edge_proposals") for d in fixed) and any(d.get("block_resolution") for d in fixed)
    assert all(d["partition_invariant"]["ok"] and d["partition_invariant"]["trusted"] == len(d.get("canonical_trusted_points") or []) for d in fixed)
    documents.write_deltas(sampling.time_deltas(sampling.edges(ingestion.accepted(raw))), str(tmp_path / "deltas"))
    assert spark.read.json(str(tmp_path / "deltas")).count() > 0


def test_synthetic_tracks_keep_their_points(spark):
    raw = synthetic.tracks(spark, 20)
    report = correction.partition(correction.correct(raw)).collect()
    assert len(report) == 20 and all(r.ok and r.ingested == 60 for r in report)
    assert raw.filter(F.col("time_ms").isNull()).count() == raw.filter("time_absent").count()
