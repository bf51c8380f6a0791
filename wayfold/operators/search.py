"""Search of names by the beginning of any of their words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.text import search_form

#: Fixed values of the reference: suggestions shown, characters of a prefix that count.
SHOWN, PREFIX_LENGTH, LEAST_TYPED = 8, 60, 2


def index(names: DataFrame, column: str, aliases: DataFrame | None = None) -> DataFrame:
    """(name, suffix, at): each name's suffixes that start at a word, and the whole of its aliases (name, alias)."""
    words = F.split(column, " ")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: search_form(F.array_join(F.slice(words, i, F.size(words)), " ")))
    out = names.select(F.col(column).alias("name"), F.posexplode(suffixes).alias("at", "suffix"))
    # an alias finds a station, but its name doesn't start with it
    return out if aliases is None else out.unionByName(aliases.join(names.select(F.col(column).alias("name")), "name", "left_semi").select("name", F.lit(1).alias("at"), search_form(F.col("alias")).alias("suffix")))


def suggested(suffixes: DataFrame, typed: DataFrame, least_typed: int) -> DataFrame:
    """(raw, name, at): the names that typed texts (raw) find, and the first word that begins so.

    Suffixes are cut to each length that is typed, of which there are
    PREFIX_LENGTH at most, and meet the prefixes by equality.
    """
    raw = F.btrim("raw")
    prefixes = typed.where(F.length(raw) >= least_typed).select("raw", search_form(F.substring(raw, 1, PREFIX_LENGTH)).alias("prefix"))
    sizes = prefixes.select(F.length("prefix").alias("size")).distinct()
    cut = suffixes.join(F.broadcast(sizes), F.length("suffix") >= F.col("size")).select("name", "at", F.expr("left(suffix, size)").alias("prefix")).distinct()
    return cut.join(prefixes, "prefix").groupBy("raw", "name").agg(F.min("at").alias("at"))


def suggestions(suffixes: DataFrame, typed: DataFrame, least_typed: int = 0) -> DataFrame:
    """(raw, name, rank) of typed texts (raw): names that start with the prefix first, then by Unicode's collation; an empty prefix finds all.

    Texts of fewer than least_typed characters find nothing.
    """
    order = Window.partitionBy("raw").orderBy(F.col("at") > 0, F.collate("name", "UNICODE"), "name")
    return suggested(suffixes, typed, least_typed).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= SHOWN).select("raw", "name", "rank")


def ranked_stations(stations: DataFrame, typed: DataFrame) -> DataFrame:
    """(raw, id, name, mode, rank): all stations (id, name, mode) that a typed text (raw) finds, in order.

    Names that begin with the text come first, then names by the rules of
    Unicode's collation (accents and case decide only between equal letters),
    then local stations before others of their name. An empty text finds all.
    """
    hits = suggested(index(stations.select(F.col("name").alias("station")).distinct(), "station"), typed, 0)
    order = Window.partitionBy("raw").orderBy(F.col("at") > 0, F.collate("name", "UNICODE"), F.col("mode") != "LOCAL", "id")
    return hits.join(stations.select("id", "name", "mode"), "name").withColumn("rank", F.row_number().over(order).cast("long")).select("raw", "id", "name", "mode", "rank")


def station_records(stops: DataFrame, calls: DataFrame, trips: DataFrame) -> DataFrame:
    """(id, name, lat, lon, mode, line, lines) of stops (id, name, lat, lon, mode, line): lines are the routes of trips (trip, route) with calls (trip, stop) there, in order.

    An empty line is none. Calls of unknown trips and trips without a route
    count for nothing; a stop that no trip serves has no lines.
    """
    served = calls.join(trips.where("route IS NOT NULL").select("trip", "route"), "trip").select(F.col("stop").alias("id"), "route").distinct()
    lines = served.groupBy("id").agg(F.sort_array(F.collect_list("route")).alias("lines"))
    return stops.join(lines, "id", "left").select("id", "name", "lat", "lon", "mode", F.nullif("line", F.lit("")).alias("line"), F.coalesce("lines", F.array().cast("array<string>")).alias("lines"))
