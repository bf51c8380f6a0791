"""From printed timetables and headways to trips: grids, aliases, runs, assembly and generated departures."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.text import clean_name, normal_name, shape_id
from wayfold.functions.timefn import rollover, to_hhmm

# A train's number, what a header cell holds, what no station's name holds, and the least minutes between metro stations.
TRAIN_NUMBER = r"\b(\d{5}[A-Z]?)\b"
HEADER_START, HEADER_CELLS = "STATION", ["TR.NO", "TRAIN NO"]
NOT_A_STATION = ["LADIES ONLY", "TIME TABLE", "W.E.F", "TRAINS"]
LEAST_SEGMENT_MINUTES = 1.0
#: Calls that a batch of assembled trips has, or a train's more.
ASSEMBLED = 10_000


def is_header(cell: Column) -> Column:
    u = F.upper(cell)
    return u.startswith(HEADER_START) | reduce(or_, (u.contains(h) for h in HEADER_CELLS))


def is_station(cell: Column) -> Column:
    """Whether a cell names a station: not empty, no long cell of two lines, and no title."""
    u = F.upper(cell)
    return ~((F.btrim(cell) == "") | (cell == "nan") | ((F.length(cell) > 30) & cell.contains("\n")) | reduce(or_, (u.contains(t) for t in NOT_A_STATION)))


def train_numbers(cell: Column) -> Column:
    """All train numbers in the first line of a header cell."""
    return F.regexp_extract_all(F.element_at(F.split(cell, "\n"), 1), F.lit(TRAIN_NUMBER), F.lit(1))


def unpivot(grid: DataFrame) -> DataFrame:
    """(train_number, station, time) of a sheet (sheet, row, name, cells).

    A header row (its name starts with STATION or holds TR.NO or TRAIN NO) says which trains its columns
    hold, down to the next header; a header cell without a number takes the one
    that fills a cell of the next three rows. A cell of two trains holds two
    times. Cells that are no time are left out.
    """
    cells = grid.select("sheet", "row", "name", F.posexplode("cells").alias("column", "cell"))
    down = Window.partitionBy("sheet", "column").orderBy("row")
    header = is_header(F.col("name"))
    below = F.coalesce(*(F.nullif(F.regexp_extract(F.btrim(F.lead("cell", k).over(down)), r"^(\d{5}[A-Z]?)$", 1), F.lit("")) for k in (1, 2, 3)))
    own = train_numbers(F.col("cell"))
    numbers = F.when(header, F.when(F.size(own) > 0, own).when((F.btrim("cell") != "") & below.isNotNull(), F.array(below)).otherwise(F.array().cast("array<string>")))
    carried = cells.withColumn("numbers", numbers).withColumn("trains", F.last("numbers", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    rows = carried.where(~header & (F.size("trains") > 0) & is_station(F.col("name")))
    parts = F.split(F.btrim("cell"), r"\s+")
    parts = F.when((F.size("trains") > 1) & (F.size(parts) == F.size("trains")), parts).otherwise(F.array_repeat(F.btrim("cell"), F.size("trains")))
    pairs = rows.select("sheet", "row", "name", F.explode(F.arrays_zip(F.col("trains"), parts.alias("parts"))).alias("x")).select("sheet", "row", F.col("x.trains").alias("train_number"), F.btrim("name").alias("station"), to_hhmm(F.col("x.parts")).alias("time"))
    return pairs.where(F.col("time").isNotNull())


def backward(calls: DataFrame) -> DataFrame:
    """(train, source, from_stop, to_stop): neighbours in the last run of a train in a source whose times go back.

    calls: (train, source, n, stop, minute) in the sheet's own order. Earlier
    runs of a train are not looked at; times past midnight are put right first.
    """
    numbered = runs(calls, "train", "source", carried=("minute",))
    whole = Window.partitionBy("train", "source")
    last = numbered.withColumn("last", F.max("run").over(whole)).where("run = last")
    timed = last.withColumn("at", past_midnight(F.col("minute"), F.min("minute").over(whole), F.max("minute").over(whole)))
    order = whole.orderBy("n")
    pairs = timed.withColumns({"next": F.lead("stop").over(order), "next_at": F.lead("at").over(order)})
    return pairs.where(F.col("next_at") < F.col("at")).select("train", "source", F.col("stop").alias("from_stop"), F.col("next").alias("to_stop"))


def assembled_lines(parts: DataFrame, renames: DataFrame) -> DataFrame:
    """(line, pos, name, lat, lon): stations in order, from parts (line, part, reverse, skip, stops: array of (name, lat, lon)).

    A part may run backwards and leave out its first stations then; renames
    (line, name, new_name) apply to cleaned names.
    """
    turned = F.when(F.coalesce("reverse", F.lit(False)), F.reverse("stops")).otherwise(F.col("stops"))
    used = F.slice(turned, F.coalesce("skip", F.lit(0)) + 1, F.greatest(F.size(turned) - F.coalesce("skip", F.lit(0)), F.lit(0)))
    rows = parts.select("line", "part", F.posexplode(used).alias("i", "s")).select("line", "part", "i", clean_name(F.col("s.name")).alias("name"), "s.lat", "s.lon")
    named = rows.join(renames.select("line", "name", "new_name"), ["line", "name"], "left")
    pos = F.row_number().over(Window.partitionBy("line").orderBy("part", "i")) - 1
    return named.select("line", pos.cast("long").alias("pos"), F.coalesce("new_name", "name").alias("name"), "lat", "lon")


def unique_names(stations: DataFrame) -> DataFrame:
    """The stations of lines (line, name); two of one name on a line are an error."""
    twice = stations.groupBy("line", "name").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"stations of one name on a line: {[(r['line'], r['name']) for r in twice]}")
    return stations


def offsets(segments: DataFrame, lines: DataFrame) -> DataFrame:
    """(line, pos, offset): minutes from a line's first station, of segments (line, pos, metres) that end at pos.

    lines: (line, end_to_end, speed); a line without minutes from end to end
    takes those of its length at its speed in km/h. They are dealt over the
    segments by length, a minute to each at least.
    """
    whole = Window.partitionBy("line")
    rows = segments.join(lines, "line").withColumn("all", F.sum("metres").over(whole))
    minutes = F.coalesce("end_to_end", F.col("all") / 1000 / F.col("speed") * 60)
    rows = rows.withColumn("minutes", F.greatest(F.lit(LEAST_SEGMENT_MINUTES), minutes * F.col("metres") / F.col("all")))
    ends = rows.select("line", "pos", F.sum("minutes").over(whole.orderBy("pos")).alias("offset"))
    return ends.unionByName(segments.select("line").distinct().select("line", F.lit(0).cast("long").alias("pos"), F.lit(0.0).alias("offset")))


def alias_table(stations: DataFrame) -> DataFrame:
    """(alias, name) of stations (name, raw_names)."""
    return stations.select("name", F.explode(F.array_union(F.array("name"), "raw_names")).alias("raw")).select(normal_name(F.col("raw")).alias("alias"), "name").distinct()


def alias_conflicts(stations: DataFrame) -> DataFrame:
    return alias_table(stations).groupBy("alias").agg(F.count("*").alias("names")).where("names > 1")


def resolve(rows: DataFrame, stations: DataFrame) -> DataFrame:
    """rows with a column station, and the station's name, null where no alias fits.

    The rule that an alias is one station's stands in the plan: a job that looks
    up an alias of several ends with an error.
    """
    names = alias_table(stations).groupBy("alias").agg(F.min("name").alias("name"), F.count("*").alias("names"))
    joined = rows.withColumn("alias", normal_name(F.col("station"))).join(names, "alias", "left")
    clash = F.raise_error(F.concat(F.lit("alias of several stations: "), F.col("alias"))).cast("string")
    return joined.withColumn("name", F.when(F.col("names") > 1, clash).otherwise(F.col("name"))).drop("alias", "names")


def past_midnight(times: Column, least: Column, most: Column) -> Column:
    """Times of a run that spans 18 hours by its whole hours: those before noon are a day later."""
    return times + F.when((F.floor(most / 60) - F.floor(least / 60) >= 18) & (times < 720), 1440).otherwise(0)


def rolled_over(calls: DataFrame) -> DataFrame:
    """(trip, seq, arr, dep) of calls whose times are of one day, made to go on past midnight."""
    rows = calls.groupBy("trip").agg(rollover(F.array_sort(F.collect_list(F.struct("seq", "arr", "dep")))).alias("c"))
    return rows.select("trip", F.explode("c").alias("c")).select("trip", "c.*")


def runs(calls: DataFrame, *keys: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n, stop, carried, run): a stop that repeats in a run starts the next one; keys name a trip's columns, trip if none.

    Rows that are dealt by some of the keys already aren't dealt again.
    """
    keys = keys or ("trip",)
    start = F.from_json(F.lit('{"run":0,"seen":[],"out":[]}'), "struct<run:bigint,seen:array<bigint>,out:array<bigint>>")

    def step(acc: Column, c: Column) -> Column:
        again = F.array_contains(acc["seen"], c["stop"])
        run = acc["run"] + again.cast("long")
        seen = F.when(again, F.array(c["stop"])).otherwise(F.concat(acc["seen"], F.array(c["stop"])))
        return F.struct(run.alias("run"), seen.alias("seen"), F.concat(acc["out"], F.array(run)).alias("out"))

    folded = calls.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "stop", *carried))).alias("c"))
    numbered = folded.select(*keys, F.inline(F.arrays_zip("c", F.aggregate("c", start, step)["out"].alias("run"))))
    return numbered.select(*keys, "c.*", "run")


def fold_pieces(pieces: list[tuple[str, list[tuple[int, int]]]]) -> list[tuple[str, dict[int, tuple[int, int]]]]:
    """Trips of one train from its pieces (source, [(stop, minute)]) in order of priority.

    A piece that shares two stops with a trip of another source repeats it and
    goes; so does a single stop. One shared stop joins the piece to that trip,
    with the earlier arrival and the later departure there. Everything else is
    a trip of its own. Of equal overlaps, the later trip counts.
    """
    trips: list[tuple[str, dict[int, tuple[int, int]]]] = []
    for source, calls in pieces:
        shared = [(len(trip.keys() & {s for s, _ in calls}), i) for i, (other, trip) in enumerate(trips) if other != source]
        most, target = max(shared, default=(0, -1))
        if most >= 2 or len(calls) < 2:
            continue
        if most == 0:
            trips.append((source, {s: (t, t) for s, t in calls}))
            continue
        trip = trips[target][1]
        for s, t in calls:
            arr, dep = trip.get(s, (t, t))
            trip[s] = (min(arr, t), max(dep, t))
    return [(source, trip) for source, trip in trips if len(trip) > 1]


def assemble(pieces: DataFrame, dealt: bool = False) -> DataFrame:
    """(trip_id, source, stop, arr, dep, seq) from pieces (train, piece, source, n, stop, minute), by train.

    Trips of a train are named train, train-2 and so on; calls are in order of
    time, then of their appearance. Rows are dealt and sorted by train, and a
    task holds those of one train at a time. dealt: all rows of a train lie in
    one task already, as those of ordered_pieces do.
    """

    def one_train(train: str | None, rows: list[tuple]) -> list[tuple]:
        parts = [(own[0][2], [(stop, minute) for *_, stop, minute in own]) for own in (list(g) for _, g in groupby(rows, itemgetter(1)))]
        out = []
        for i, (source, trip) in enumerate(fold_pieces(parts)):
            name = f"{train}" + (f"-{i + 1}" if i else "")
            times = [t for pair in trip.values() for t in pair]
            late = max(times) // 60 - min(times) // 60 >= 18
            add = lambda t: t + 1440 if late and t < 720 else t  # noqa: E731, B023
            calls = sorted((add(a), add(d), k, s) for k, (s, (a, d)) in enumerate(trip.items()))
            out += [(name, source, s, a, d, seq) for seq, (a, d, _, s) in enumerate(calls, 1)]
        return out

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    def by_train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        held = []
        for train, own in groupby(rows, itemgetter(0)):
            held += one_train(train, list(own))
            if len(held) >= ASSEMBLED:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    schema = pa.schema([(c, pa.string() if c in ("trip_id", "source") else pa.int64()) for c in ("trip_id", "source", "stop", "arr", "dep", "seq")])
    rows = pieces.select("train", "piece", "source", "n", "stop", "minute")
    rows = (rows if dealt else rows.repartition("train")).sortWithinPartitions("train", "piece", "n")
    return rows.mapInArrow(by_train, "trip_id string, source string, stop long, arr long, dep long, seq long")


def ordered_pieces(calls: DataFrame, sources: DataFrame) -> DataFrame:
    """(train, piece, source, n, stop, minute): the runs of each train (train, source, n, stop, minute), numbered by their source's priority.

    sources: (source, priority), the least first; rows of a source that isn't
    listed take no part. n is a call's place in its sheet; a stop that repeats
    there starts the next piece. Calls that are dealt by train aren't dealt again.
    """
    listed = calls.join(F.broadcast(sources.select("source", "priority")), "source")
    rows = runs(listed, "train", "priority", "source", carried=("minute",))
    piece = F.dense_rank().over(Window.partitionBy("train").orderBy("priority", "source", "run"))
    return rows.select("train", piece.cast("long").alias("piece"), "source", "n", "stop", "minute")


def chronological(calls: DataFrame) -> DataFrame:
    """(trip, seq, stop, arr, dep) of calls (trip, n, stop, arr, dep): numbered from 1 by arrival, departure and n.

    Times are of one day; a trip whose times span 18 hours goes on past midnight.
    """
    trip = Window.partitionBy("trip")
    ends = {"least": F.min(F.least("arr", "dep")).over(trip), "most": F.max(F.greatest("arr", "dep")).over(trip)}
    timed = calls.withColumns(ends).withColumns({c: past_midnight(F.col(c), F.col("least"), F.col("most")) for c in ("arr", "dep")})
    return timed.select("trip", F.row_number().over(trip.orderBy("arr", "dep", "n")).cast("long").alias("seq"), "stop", "arr", "dep")


def known_branches(branches: DataFrame, stops: DataFrame) -> DataFrame:
    """(ord, route, stop) of branches (ord, route, stops: array); a job that reads one of a stop that stops (stop) lacks ends with an error."""
    own = stops.select("stop").distinct().withColumn("known", F.lit(True))
    rows = branches.select("ord", "route", F.explode(F.array_distinct("stops")).alias("stop")).join(own, "stop", "left")
    unknown = F.raise_error(F.concat_ws(" ", F.lit("unknown stop of branch"), "route", F.col("stop").cast("string"))).cast("long")
    return rows.select("ord", "route", F.coalesce(F.when(F.col("known"), F.col("stop")), unknown).alias("stop"))


def filed_trips(calls: DataFrame, branches: DataFrame, families: DataFrame) -> DataFrame:
    """(trip, route, direction, shape, shared, n_calls) of calls (trip, source, seq, stop).

    A trip is of the first branch (ord, route, stop) that it has a stop of, and
    shared are its stops there, in order of their ids; else of its source's
    family (family, route), the part of a source's name before the first _. A
    source of no family is an error then. Sources whose names end in up run in
    direction 0, those in dn in direction 1, others in none. Calls meet their
    branches, a row for each stop that has some, where they lie, and are dealt
    by trip once, unless they are already.
    """
    at = branches.groupBy("stop").agg(F.array_sort(F.collect_set(F.struct("ord", "route"))).alias("branches"))
    met = calls.select("trip", "source", "seq", "stop").join(F.broadcast(at), "stop", "left")
    whole = met.groupBy("trip").agg(F.min("source").alias("source"), F.array_sort(F.collect_list(F.struct("seq", "stop", "branches"))).alias("calls"))
    first = F.array_min(F.transform("calls", lambda c: c["branches"][0]))
    rows = whole.withColumns({"first": first, "stops": F.transform("calls", lambda c: c["stop"].cast("string"))})
    shared = F.transform(F.filter("calls", lambda c: F.array_contains(c["branches"], F.col("first"))), lambda c: c["stop"])
    branch = F.when(F.col("first").isNotNull(), F.struct(F.col("first.route").alias("route"), F.array_sort(F.array_distinct(shared)).alias("shared")))
    rows = rows.select("trip", "source", "stops", branch.alias("branch"), F.split_part("source", F.lit("_"), F.lit(1)).alias("family")).join(F.broadcast(families.select("family", F.col("route").alias("own"))), "family", "left")
    none = F.raise_error(F.concat(F.lit("no route for trains of "), F.col("source"))).cast("string")
    rows = rows.withColumn("route", F.coalesce("branch.route", "own", none))
    direction = F.when(F.endswith("source", F.lit("up")), 0).when(F.endswith("source", F.lit("dn")), 1)
    return rows.select("trip", "route", direction.cast("long").alias("direction"), shape_id(F.col("route"), F.col("stops")).alias("shape"), F.coalesce(F.array_join(F.transform("branch.shared", lambda x: x.cast("string")), " "), F.lit("")).alias("shared"), F.size("stops").cast("long").alias("n_calls"))


def shape_routes(trips: DataFrame) -> DataFrame:
    """(shape, route) of trips (n, shape, route): the route of each shape's last trip by n, also if it has none."""
    return trips.where("shape IS NOT NULL").groupBy("shape").agg(F.max_by(F.struct("route"), "n").alias("last")).select("shape", "last.route")


def headway_departures(directions: DataFrame, bands: DataFrame) -> DataFrame:
    """(line, dir, minute): departures from the first on, each a headway after the one before, and the last one always.

    directions: (line, dir, first, last); bands: (line, start, stop, minutes),
    which don't overlap. A direction is a fold over its line's bands: how many
    steps a band takes from where the one before it led is a division, and what
    they lead beyond its end is carried on. A minute before the last departure
    that no band covers is an error, and so is a headway that isn't positive.
    """
    by_line = bands.groupBy("line").agg(F.array_sort(F.collect_list(F.struct("start", "stop", F.col("minutes").cast("double").alias("minutes")))).alias("bands"))
    kind = "array<struct<minute:double,steps:bigint,headway:double>>"
    start = F.struct(F.col("first").cast("double").alias("minute"), F.array().cast(kind).alias("out"))

    def step(acc: Column, band: Column) -> Column:
        headway = F.when(band["minutes"] > 0, band["minutes"]).otherwise(F.raise_error(F.lit("a headway must be positive")).cast("double"))
        inside = (acc["minute"] < F.col("last")) & (acc["minute"] >= band["start"]) & (acc["minute"] < band["stop"])
        steps = F.ceil((F.least(band["stop"], F.col("last")) - acc["minute"]) / headway).cast("long")
        run = F.struct(acc["minute"].alias("minute"), steps.alias("steps"), headway.alias("headway"))
        return F.when(inside, F.struct((acc["minute"] + steps * headway).alias("minute"), F.concat(acc["out"], F.array(run)).alias("out"))).otherwise(acc)

    # both sides grow with the lines, so neither is sent to all
    folded = directions.hint("merge").join(by_line, "line").select("line", "dir", "last", F.aggregate("bands", start, step).alias("x"))
    covered = F.when(F.col("x.minute") >= F.col("last"), F.col("x.out")).otherwise(F.raise_error(F.lit("no headway band covers a departure")).cast(kind))
    runs = folded.select("line", "dir", F.inline(covered)).select("line", "dir", "minute", "headway", F.explode(F.sequence(F.lit(0).cast("long"), F.col("steps") - 1)).alias("i"))
    return runs.select("line", "dir", (F.col("minute") + F.col("i") * F.col("headway")).alias("minute")).unionByName(directions.select("line", "dir", F.col("last").cast("double").alias("minute")))


def metro_stop_times(departures: DataFrame, offsets: DataFrame) -> DataFrame:
    """(trip_id, seq, minute): departures (line, dir, minute) by the stations' offsets (line, pos, offset); direction 1 runs back. Halves round to even."""
    w = Window.partitionBy("line")
    at = offsets.withColumns({"total": F.max("offset").over(w), "stations": F.count("*").over(w)})
    rows = departures.join(at, "line")
    forward = F.col("dir") == 0
    seq = F.when(forward, F.col("pos") + 1).otherwise(F.col("stations") - F.col("pos"))
    minute = F.rint(F.col("minute") + F.when(forward, F.col("offset")).otherwise(F.col("total") - F.col("offset"))).cast("long")
    name = F.format_string("%s-%d-%02d%02d", "line", "dir", F.floor(F.floor("minute") / 60).cast("long"), (F.floor("minute") % 60).cast("long"))
    return rows.select(name.alias("trip_id"), seq.cast("long").alias("seq"), minute.alias("minute"))
