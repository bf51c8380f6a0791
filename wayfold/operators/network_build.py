"""A network of all its sources as one build: tables are united, checked and written once, and what goes is counted as it goes."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wayfold.sources.shared import written

#: The tables of a source, and their columns.
TABLES = {
    "stops": "stop_id, stop_name, lat, lon, mode, line",
    "routes": "route_id, agency_id, short_name, long_name, route_type, color",
    "trips": "trip_id, route_id, direction, shape_id",
    "stop_times": "trip_id, seq, stop_id, arr, dep",
    "shapes": "shape_id, seq, lat, lon",
    "transfers": "a, b, seconds",
}


@dataclass
class Network:
    """The tables that were built, by name, and how many rows of each went for what reason."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    dropped: dict[str, dict[str, int]] = field(default_factory=dict)

    def keep(self, name: str, rows: DataFrame, **reasons: Column) -> DataFrame:
        """Write the rows that no reason drops. Each row counts for its first reason, in the job that writes the others.

        Tasks that run again after a loss may count a row twice; the rows
        written are always right.
        """
        first: Column = F.lit(None).cast("string")
        for reason, holds in reversed(reasons.items()):
            first = F.when(F.coalesce(holds, F.lit(False)), reason).otherwise(first)
        told = rows.withColumn("dropped_as", first)
        seen = Observation(f"{name} dropped")
        if reasons:
            told = told.observe(seen, *(F.count_if(F.col("dropped_as") == r).alias(r) for r in reasons))
        self.tables[name] = written(told.where("dropped_as IS NULL").select(*TABLES[name].split(", ")), name)
        self.dropped[name] = {r: int(n) for r, n in seen.get.items()} if reasons else {}
        return self.tables[name]


def _marked(rows: DataFrame, keys: DataFrame, column: str, mark: str) -> DataFrame:
    """rows with a column that is true where keys has theirs; keys hold each once."""
    return rows.join(keys.select(F.col(keys.columns[0]).alias(column), F.lit(True).alias(mark)), column, "left").withColumn(mark, F.coalesce(mark, F.lit(False)))


def build(*sources: dict[str, DataFrame]) -> Network:
    """One network of the tables of several sources; a source may lack some (see TABLES).

    Stops without an id go, and of a stop or trip that comes twice all but one.
    Calls of unknown trips or stops go, then trips without calls, routes without
    trips, shapes that no trip has, and transfers from a stop to itself or with
    an unknown end. Every table is read once and written once, but for trips:
    their ids alone are read for the calls, so that trips are dealt by id once.
    """
    whole = {name: reduce(DataFrame.unionByName, [s[name].select(*columns.split(", ")) for s in sources if name in s]) for name, columns in TABLES.items() if any(name in s for s in sources)}
    out = Network()

    def once(rows: DataFrame, key: str) -> DataFrame:
        """Rows of equal keys as one, the least of them, and how many there were."""
        others = [c for c in rows.columns if c != key]
        grouped = rows.groupBy(key).agg(F.min(F.struct(*others)).alias("x"), F.count("*").alias("times"))
        return grouped.select(key, "x.*", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy"))

    stops = out.keep("stops", once(whole["stops"], "stop_id"), without_id=F.coalesce("stop_id", F.lit("")) == "", twice=F.col("copy") > 1)
    calls = _marked(_marked(whole["stop_times"], stops.select("stop_id"), "stop_id", "has_stop"), whole["trips"].select("trip_id").distinct(), "trip_id", "has_trip")
    calls = out.keep("stop_times", calls, unknown_trip=~F.col("has_trip"), unknown_stop=~F.col("has_stop"))
    trips = out.keep("trips", _marked(once(whole["trips"], "trip_id"), calls.select("trip_id").distinct(), "trip_id", "called"), twice=F.col("copy") > 1, without_calls=~F.col("called"))
    out.keep("routes", _marked(whole["routes"], trips.select("route_id").distinct(), "route_id", "used"), without_trips=~F.col("used"))
    if "shapes" in whole:
        out.keep("shapes", _marked(whole["shapes"], trips.select("shape_id").distinct(), "shape_id", "used"), without_trips=~F.col("used"))
    if "transfers" in whole:
        ends = _marked(_marked(whole["transfers"], stops.select("stop_id"), "a", "has_a"), stops.select("stop_id"), "b", "has_b")
        out.keep("transfers", ends, to_itself=F.col("a") == F.col("b"), unknown_end=~F.col("has_a") | ~F.col("has_b"))
    return out
