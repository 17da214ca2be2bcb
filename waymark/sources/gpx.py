"""GPX documents as rows: one pass of an XML parser numbers points and segments; columns are typed by Spark.

Names are matched without their namespaces. A document that is not well formed gives one row of kind `error` and the others go on.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import iso_millis, leading_number, text_or_null

#: kind: trkpt, wpt, rte, rtept, trkseg (one for each segment, also an empty one) or error.
SCHEMA = (
    "track_id string, kind string, gpx_index long, trk_seg_index int, track_index int, seg_index int, route_index int, raw_lat string, raw_lon string, "
    "raw_ele string, raw_time string, name string, desc string, sym string, type string, error string")


def _local(node: ET.Element) -> str:
    return node.tag.rsplit("}", 1)[-1] if isinstance(node.tag, str) else ""


def _all(node: ET.Element, name: str) -> Iterator[ET.Element]:
    return (n for n in node.iter() if n is not node and _local(n) == name)


def _text(node: ET.Element, name: str) -> str | None:
    """The text of the first descendant of that name, with all text inside it."""
    found = next(_all(node, name), None)
    return None if found is None else "".join(found.itertext())


def _spot(node: ET.Element) -> dict:
    time = _text(node, "time")
    return {"raw_lat": node.get("lat"), "raw_lon": node.get("lon"), "raw_ele": _text(node, "ele"), "raw_time": None if time is None else time.strip()}


def _words(node: ET.Element, *names: str) -> dict:
    found = ((n, _text(node, n)) for n in names)
    return {n: t.strip() or None for n, t in found if t is not None}


def scan(track_id: str | None, document: str | None) -> list[dict]:
    """The rows of one document."""
    try:
        root = ET.fromstring((document or "").strip())
    except ET.ParseError as e:
        return [{"track_id": track_id, "kind": "error", "error": f"not well formed: {e}"}]
    rows: list[dict] = []
    for k, n in enumerate(_all(root, "wpt")):
        rows.append({"kind": "wpt", "gpx_index": k} | _spot(n) | _words(n, "name", "desc", "sym", "type"))
    for r, route in enumerate(_all(root, "rte")):
        rows.append({"kind": "rte", "route_index": r} | _words(route, "name", "desc"))
        for k, n in enumerate(_all(route, "rtept")):
            rows.append({"kind": "rtept", "route_index": r, "gpx_index": k} | _spot(n) | _words(n, "name", "desc", "sym", "type"))
    gpx = seg = 0
    for t, track in enumerate(_all(root, "trk")):
        for k, segment in enumerate(_all(track, "trkseg")):
            rows.append({"kind": "trkseg", "trk_seg_index": seg, "track_index": t, "seg_index": k})
            for n in _all(segment, "trkpt"):
                rows.append({"kind": "trkpt", "gpx_index": gpx, "trk_seg_index": seg, "track_index": t, "seg_index": k} | _spot(n))
                gpx += 1
            seg += 1
    return [{"track_id": track_id} | r for r in rows]


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in SCHEMA.split(", "))])
    for batch in batches:
        for track_id, document in zip(batch.column("track_id").to_pylist(), batch.column("gpx").to_pylist()):
            yield pa.RecordBatch.from_pylist(scan(track_id, document), schema=schema)


def parse(documents: DataFrame) -> DataFrame:
    """Rows (SCHEMA) of documents (track_id, gpx)."""
    return documents.select(F.col("track_id").cast("string").alias("track_id"), F.col("gpx").cast("string").alias("gpx")).mapInArrow(_scan_batches, SCHEMA)


def raw_points(rows: DataFrame) -> DataFrame:
    """Track points with typed columns beside the raw ones; lat and lon are null if they are no numbers."""
    spot = rows.filter("kind = 'trkpt'")
    number = lambda c: F.when(F.abs(leading_number(c)) < float("inf"), leading_number(c))
    return spot.select(
        "track_id", "gpx_index", "trk_seg_index", "track_index", leading_number("raw_lat").alias("lat"), leading_number("raw_lon").alias("lon"), number("raw_ele").alias("ele"), F.col("raw_ele").isNull().alias("ele_absent"),
        text_or_null("raw_time").alias("time_raw"), F.col("raw_time").isNull().alias("time_absent"), iso_millis("raw_time").alias("time_ms"), "raw_lat", "raw_lon", "raw_ele", "raw_time")


def structure(rows: DataFrame) -> DataFrame:
    """A row for each segment, also an empty one, waypoint and route of a document."""
    return rows.filter("kind in ('trkseg', 'wpt', 'rte')").select("track_id", "kind", "trk_seg_index", "track_index")


def rejection_text() -> Column:
    """The reason of a refused point in words."""
    quoted = lambda c: F.coalesce(F.col(c), F.lit("null"))
    bad = F.concat(F.lit('Invalid coordinates: lat="'), quoted("raw_lat"), F.lit('", lon="'), quoted("raw_lon"), F.lit('" (not parseable as numbers)'))
    far = F.concat(F.lit("Coordinates out of valid range or non-finite: lat="), F.col("lat").cast("string"), F.lit(" (must be -90 to 90), lon="), F.col("lon").cast("string"), F.lit(" (must be -180 to 180)"))
    return F.when(F.col("lat").isNull() | F.col("lon").isNull(), bad).otherwise(far)


def reference_points(rows: DataFrame) -> DataFrame:
    """Waypoints and route points: coordinates are null if invalid, the row stays."""
    lat, lon = leading_number("raw_lat"), leading_number("raw_lon")
    ok = F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))
    spot = rows.filter("kind in ('wpt', 'rtept')")
    return spot.select(
        "track_id", "kind", "route_index", "gpx_index", ok.alias("coords_valid"), F.when(ok, lat).alias("lat"), F.when(ok, lon).alias("lon"), leading_number("raw_ele").alias("ele"), iso_millis("raw_time").alias("time_ms"), "name", "desc", "sym", "type")


def routes(rows: DataFrame) -> DataFrame:
    """One row for each route with its points in order."""
    head = rows.filter("kind = 'rte'").select("track_id", "route_index", "name", "desc")
    pts = reference_points(rows).filter("kind = 'rtept'").groupBy("track_id", "route_index").agg(F.sort_array(F.collect_list(F.struct("gpx_index", "lat", "lon", "ele", "time_ms", "name"))).alias("points"))
    return head.join(pts, ["track_id", "route_index"], "left")


def errors(rows: DataFrame) -> DataFrame:
    """Documents that could not be read."""
    return rows.filter("kind = 'error'").select("track_id", "error")


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """track_id (the file's name without .gpx), gpx of every .gpx file of a folder."""
    files = spark.read.option("pathGlobFilter", "*.gpx").text(path, wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.gpx$", 1).alias("track_id"), F.col("value").alias("gpx"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """track_id, gpx and the other columns of a CSV file with a header and a column gpx of many lines. Rows without a document are
    left out; a row without _id is row-N by its place in its file, counted from 1 over all rows (a file of rows of many lines is read by one task,
    so its rows have numbers in a row; where it begins is found by a first pass over the narrow columns)."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    rows = rows.withColumns({"_n": F.monotonically_increasing_id(), "_file": F.input_file_name()})
    begins = rows.groupBy("_file").agg(F.min("_n").alias("_begin"))
    rest = [c for c in rows.columns if c not in ("_id", "gpx", "_n", "_file", "track_id")]
    rows = rows.filter(F.trim("gpx") != "").join(begins, "_file").withColumn("_n", F.col("_n") - F.col("_begin") + 1)
    return rows.select(F.coalesce(text_or_null("_id"), F.concat(F.lit("row-"), F.col("_n").cast("string"))).alias("track_id"), "gpx", *rest)


def page(documents: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A stretch of documents in order of track_id."""
    out = documents.orderBy("track_id").offset(offset)
    return out if limit is None else out.limit(limit)
