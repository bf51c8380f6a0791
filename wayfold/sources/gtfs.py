"""Sources and sinks: timetable CSV tables with declared schemas, JSON definitions, KML tracks, and files for readers of GeoJSON.

Ids stay strings, times stay text until parsed, a missing table is empty and a
column that a file lacks is null or, for strings, empty.
"""

from __future__ import annotations

import csv
import io
import posixpath
from collections.abc import Iterator

from pyspark.errors import AnalysisException
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS: dict[str, str] = {
    "agency": "agency_id string, agency_name string, agency_url string, agency_timezone string, agency_lang string",
    "calendar": "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date int, end_date int",
    "routes": "route_id string, agency_id string, route_short_name string, route_long_name string, route_type int, route_color string",
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double, stop_mode string, stop_line string",
    "trips": "route_id string, service_id string, trip_id string, direction_id int, shape_id string",
    "stop_times": "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence int",
    "transfers": "from_stop_id string, to_stop_id string, transfer_type int, min_transfer_time int, distance_m int",
    "shapes": "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int",
    "timetable": "train_number string, station string, time string",
}
_CSV = {"header": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "enforceSchema": False}

LINES_JSON = (
    "array<struct<id:string,name:string,short_name:string,color:string,mode:string,agency:string,active:boolean,end_to_end_minutes:double,avg_speed_kmh:double,"
    "directions:array<struct<`from`:string,first:string,last:string>>,headway_minutes:array<array<string>>,parts:array<struct<osm:string,reverse:boolean,skip:array<string>>>,rename:map<string,string>>>"
)


def read_table(spark: SparkSession, folder: str, name: str, suffix: str = "txt") -> DataFrame:
    """A table by the names in its file's header, whatever their order; blank lines and short rows are taken as they come."""
    schema = T.StructType.fromDDL(SCHEMAS[name])
    try:
        raw = spark.read.options(**{**_CSV, "inferSchema": False}).csv(f"{folder}/{name}.{suffix}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)

    def column(f: T.StructField) -> Column:
        if f.name not in raw.columns:
            return F.lit("" if isinstance(f.dataType, T.StringType) else None).cast(f.dataType).alias(f.name)
        text = F.rtrim(F.col(f"`{f.name}`"), F.lit("\r"))
        return (F.coalesce(text, F.lit("")) if isinstance(f.dataType, T.StringType) else text.try_cast(f.dataType)).alias(f.name)

    return raw.select(*(column(f) for f in schema))


def write_table(df: DataFrame, path: str) -> None:
    """Header, comma, quotes only where needed, each part file with LF ends."""
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="").csv(path)


def _grid_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sheet, row, name, cells) of CSV files (path, content), a batch a file."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            lines = list(csv.reader(io.StringIO(content.as_py().decode("utf-8-sig"), newline="")))
            sheet = posixpath.splitext(posixpath.basename(path))[0]
            columns = [[sheet] * len(lines), list(range(1, len(lines) + 1)), [x[0] if x else "" for x in lines], [x[1:] for x in lines]]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["sheet", "row", "name", "cells"])


def read_grid(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Sheets saved as CSV without a header, as (sheet, row, name, cells): a sheet's first column, and the others.

    path names a file, a folder or a pattern; files are read side by side, each
    whole and in its own order, so rows are numbered however Spark deals them.
    A sheet is called by its file's name, or all by the one given.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(_grid_rows, "sheet string, row long, name string, cells array<string>")
    return rows if sheet is None else rows.withColumn("sheet", F.lit(sheet))


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """(relation, name, stops, ways) of JSON documents of map relations."""
    kind = "relation long, name string, stops array<struct<name:string,lat:double,lon:double>>, ways array<array<array<double>>>"
    return spark.read.schema(kind).option("multiLine", True).json(path)


def read_interchanges(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, metres, note) of official interchanges."""
    kind = "interchanges array<struct<a:string,b:string,meters:int,note:string>>"
    return spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode("interchanges").alias("x")).select("x.a", "x.b", F.col("x.meters").alias("metres"), "x.note")


def merged_walks(known: DataFrame, fetched: DataFrame) -> DataFrame:
    """Known walks (a, b, ..) and those fetched for pairs that lack, sorted by pair; a known walk stays as it is."""
    return known.unionByName(fetched.join(known.select("a", "b"), ["a", "b"], "left_anti")).orderBy("a", "b")


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """(name, raw_names, lat, lon) of a JSON object keyed by name."""
    kind = "map<string,struct<raw_names:array<string>,lat:double,lon:double>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("name", "s"))
    return rows.select("name", "s.*")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a JSON document {"lines": [..]}; those that aren't active are left out."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"struct<lines:{LINES_JSON}>")["lines"]).alias("l")).select("l.*")
    return rows.where(F.coalesce("active", F.lit(True)))


def read_walks(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, meters, walk_minutes) of a JSON object keyed by a|b."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<meters:int,walk_minutes:double>>")).alias("k", "w"))
    ends = F.split("k", r"\|")
    return rows.select(ends[0].alias("a"), ends[1].alias("b"), "w.*")


def missing_walks(pairs: DataFrame, cached: DataFrame) -> DataFrame:
    """Pairs (a, b) that a cache of walks lacks."""
    return pairs.join(cached, ["a", "b"], "left_anti")


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """(line, track, seq, lat, lon): vertices of the LineStrings of a KML file's placemarks."""
    marks = spark.read.format("xml").option("rowTag", "Placemark").schema("name string, LineString struct<coordinates:string>").load(path)
    points = F.posexplode(F.split(F.btrim("LineString.coordinates", F.lit(" \n\t")), r"\s+")).alias("seq", "p")
    rows = marks.where(F.col("LineString.coordinates").isNotNull()).select(F.col("name").alias("line"), F.md5("LineString.coordinates").alias("track"), points)
    parts = F.split("p", ",")
    return rows.select("line", "track", "seq", parts[1].try_cast("double").alias("lat"), parts[0].try_cast("double").alias("lon"))


def track_edges(points: DataFrame) -> DataFrame:
    """(a, b, m): edges between vertices that follow each other, vertices named by coordinates to five decimals."""
    from pyspark.sql import Window

    from wayfold.functions.geo import haversine

    w = Window.partitionBy("line", "track").orderBy("seq")
    name = F.format_string("%.5f,%.5f", "lat", "lon")
    rows = points.withColumns({"a": name, "b": F.lead(name).over(w), "lat2": F.lead("lat").over(w), "lon2": F.lead("lon").over(w)})
    return rows.where("b IS NOT NULL AND a <> b").select("a", "b", haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("m"))


def write_geojson(features: DataFrame, path: str) -> None:
    """One feature a line, gzipped."""
    features.select(F.col("feature").alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)
