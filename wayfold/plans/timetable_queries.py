"""Queries about times, names, timetables and generated trips, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import text, timefn
from wayfold.operators import search, timetable
from wayfold.plans import network
from wayfold.sources.shared import table

# Texts made of the tables' numbers, as SELECT statements and expressions that both engines read.
#: Minutes as users may type them.
MINUTES = """SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN CAST(o_orderkey % 1500 AS STRING) WHEN 1 THEN concat('-', CAST(o_orderkey % 1500 AS STRING)) WHEN 2 THEN concat(CAST(o_orderkey % 100 AS STRING), '.5')
  WHEN 3 THEN printf('%05d', o_orderkey % 1440) WHEN 4 THEN printf('%04d', o_orderkey % 1500) WHEN 5 THEN concat(' ', CAST(o_orderkey % 1440 AS STRING)) WHEN 6 THEN '' WHEN 7 THEN concat(CAST(o_orderkey AS STRING), '99999999999999999') ELSE concat(o_orderstatus, '6 00') END AS raw FROM orders"""
#: Printed times.
TIMES = """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN printf('%d:%02d', o_orderkey % 30, o_orderkey % 60) WHEN 1 THEN printf('%02d:%02d:%02d', o_orderkey % 24, o_custkey % 60, o_orderkey * 7 % 60) WHEN 2 THEN concat(printf('%02d:%02d:%02d', o_custkey % 25, o_orderkey % 60, o_custkey % 60), '.962')
  WHEN 3 THEN 'nan' WHEN 4 THEN printf('%d.%02d', o_orderkey % 24, o_custkey % 60) WHEN 5 THEN printf('%d:%d', o_orderkey % 24, o_custkey % 60) WHEN 6 THEN printf(' %02d:%02d ', o_custkey % 24, o_orderkey % 60) ELSE printf('%03d:00', o_custkey % 500) END AS raw FROM orders"""
#: Header cells of timetables.
HEADERS = """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN printf('DRD %05d', 90000 + p_partkey % 9999) WHEN 1 THEN printf('%05d      %05d', 90000 + p_partkey % 9999, 80000 + p_partkey % 9999) WHEN 2 THEN upper(substr(p_name, 1, 2)) WHEN 3 THEN printf('%05dA FAST', 90000 + p_partkey % 9999)
  WHEN 4 THEN printf('%06d', 100000 + p_partkey) ELSE concat(printf('x%05d ', 90000 + p_partkey % 9999), printf('%05d', 70000 + p_partkey % 9999), chr(10), '60001') END AS cell FROM part"""
#: Lines whose label or letter isn't that of their name.
LABELS, LETTERS = {"L2": "Second", "L5": "Fifth"}, {"L3": "X", "L5": "V"}
ALIASES = "(VALUES ('red bolt', 'rb'), ('red bolt', 'the screw'), ('no such part', 'zzz')) AS t(name, alias)"
#: Stations with names as printed; conflicting ones share some.
STATIONS = "SELECT concat('Stop ', CAST(s_suppkey AS STRING)) AS name, concat('STOP   ', CAST(s_suppkey AS STRING), '|Halt ', CAST(s_suppkey AS STRING)) AS raw_names FROM supplier"
CONFLICTING = "SELECT concat('Stop ', CAST(s_suppkey AS STRING)) AS name, concat('Stand ', CAST(s_suppkey % 70 AS STRING), '|halt  ', CAST(s_suppkey AS STRING)) AS raw_names FROM supplier"
PRINTED = "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN concat(' STOP ', CAST(c_custkey AS STRING)) WHEN 1 THEN concat('stop   ', CAST(c_custkey AS STRING), ' ') WHEN 2 THEN concat('hAlt ', CAST(c_custkey AS STRING)) ELSE c_name END AS station FROM customer"
SPELLED = "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, 'e', 'é') ELSE p_name END AS name, p_size % 13 AS kind FROM part"
MAP_NAMES = """SELECT concat('L', CAST(p_size % 5 AS STRING)) AS line, concat(p_name, CASE p_partkey % 6 WHEN 0 THEN ' (Line 4)' WHEN 1 THEN ' (North) [Line 9]' WHEN 2 THEN '  St.  K.  (eastbound)' WHEN 3 THEN ' [y] (westbound)' WHEN 4 THEN ' ' ELSE '' END) AS name FROM part"""
#: A line for each supplier: its first and last departures each way, headways by bands of the day, and stations.
DIRECTIONS = "SELECT concat('M', CAST(s_suppkey AS STRING)) AS line, 0 AS dir, 300 + s_suppkey * 7 % 90 AS first, 1260 + s_suppkey * 11 % 150 AS last FROM supplier UNION ALL SELECT concat('M', CAST(s_suppkey AS STRING)), 1, 310 + s_suppkey * 7 % 90, 1275 + s_suppkey * 11 % 150 FROM supplier"
BANDS = " UNION ALL ".join(
    f"SELECT concat('M', CAST(s_suppkey AS STRING)) AS line, {start} AS start, {stop} AS stop, {minutes} AS minutes FROM supplier"
    for start, stop, minutes in ((0, 480, "8.0 + s_suppkey % 5"), (480, 660, "2.5 + s_suppkey % 4 * 0.5"), (660, 1020, "5.25 + s_suppkey % 3"), (1020, 1440, "6.5 + s_suppkey % 200"))
)
OFFSETS = "SELECT concat('M', CAST(s_suppkey AS STRING)) AS line, p AS pos, p * (1.5 + s_suppkey % 4 * 0.25) AS offset FROM supplier, ({numbers}) WHERE p <= 2 + s_suppkey % 4"
NUMBERS = "SELECT 0 AS p UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5"
BRANCHES = "(VALUES (1, 'first tens', 0, 1), (2, 'low', 2, 9), (3, 'middle', 10, 29)) AS t(ord, branch, low, high)"
PREFIXES = "(VALUES ('re'), ('ri'), ('b'), ('gadget'), (' Sm'), (''), ('zzz'), ('w')) AS t(raw)"


def _given(spark: SparkSession, values: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {values}")


def _made(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """The rows of a statement over given tables."""
    tables = [t for t in ("orders", "customer", "part", "supplier") if f"FROM {t}" in statement]
    for t in tables:
        statement = statement.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(statement, **{t: table(spark, sf_dir, t) for t in tables})


def invalid_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts are minutes of a day: one to four digits below 1440."""
    return _made(spark, sf_dir, MINUTES).select("o_orderkey", "raw", F.coalesce(F.when(F.col("raw").rlike(r"^\d{1,4}$"), F.col("raw").try_cast("int") < 1440), F.lit(False)).alias("valid"))


def time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """minutes of the clock text of every event."""
    return table(spark, sf_dir, "events").select("event_id", timefn.parse_minutes(F.date_format("ts", "HH:mm:ss")).alias("minutes"))


def time_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """minutes of up to three days as clock texts and durations."""
    m = (F.col("o_orderkey") * 37 % 4320).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", timefn.clock(m).alias("clock"), timefn.long_clock(m).alias("long_clock"), text.duration_text(m).alias("duration"), text.metres_text(m).alias("metres"), timefn.is_next_day(m).alias("next_day"), F.when(timefn.is_clock(timefn.clock(m)), timefn.from_hhmm(timefn.clock(m))).alias("back"))


def to_hhmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """printed times, seconds rounded, wrapped at a day."""
    return _made(spark, sf_dir, TIMES).select("o_orderkey", "raw", timefn.to_hhmm(F.col("raw")).alias("time"))


def train_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """train numbers of header cells."""
    return _made(spark, sf_dir, HEADERS).select("p_partkey", "cell", F.array_join(timetable.train_numbers(F.col("cell")), " ").alias("numbers"))


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sheet, row, name, cells): each order as a printed timetable of three columns, its line items as rows.

    The first row is a header of a train, a cell without number and a cell of
    two trains; the second has the number below the header; the fourth is
    another header and the sixth a title. The others are stations with times.
    """
    n, k = F.col("n"), F.col("trip").cast("long") % 9999
    number = lambda text, base: F.format_string(text, base + k)
    hour, minute = F.col("part") % 24, F.col("part") % 60
    two = F.format_string("%02d:%02d  %d:%02d", hour, minute, (hour + 1) % 24, F.col("quantity"))
    name = F.when(n == 1, "STATIONS").when(n == 2, "").when(n == 4, "TRAIN NO.").when(n == 6, "LADIES ONLY").otherwise(F.concat(F.lit("Stop "), F.col("stop").cast("string"), F.lit(" ")))
    times = F.array(F.format_string("%d:%02d", hour, minute), F.format_string("%02d:%02d:%02d", hour, F.col("quantity"), minute), F.when(F.col("part") % 2 == 0, two).otherwise(F.format_string("%d:%02d", (hour + 2) % 24, minute)))
    cells = F.when(n == 1, F.array(number("DRD %05d", 90000), F.lit("VR"), F.concat(number("%05d      ", 80000), number("%05d", 70000))))
    cells = cells.when(n == 2, F.array(F.lit(""), number("%05d", 60000), F.lit(""))).when(n == 4, F.array(number("%05dA FAST", 50000), F.lit(""), F.lit("12 CAR"))).otherwise(times)
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select(F.col("l_orderkey").alias("trip"), F.row_number().over(order).cast("long").alias("n"), F.col("l_suppkey").alias("stop"), F.col("l_partkey").cast("long").alias("part"), F.col("l_quantity").cast("long").alias("quantity"))
    return rows.select(F.col("trip").alias("sheet"), n.alias("row"), name.alias("name"), cells.alias("cells"))


def unpivot_timetable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of timetables with a second header, cells of two trains and numbers below their header."""
    return timetable.unpivot(sheets(spark, sf_dir))


def line_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines made up from parts, with mode, label, letter and the text colour that reads on theirs."""
    number = F.col("p_partkey").cast("long")
    rows = table(spark, sf_dir, "part").select(
        F.concat(F.lit("L"), number.cast("string")).alias("id"), F.concat("p_name", F.lit(" Line")).alias("name"), F.upper(F.substring("p_name", 1, 3)).alias("short_name"),
        F.format_string("#%06X", (number * 7919 * 613) % 16777216).alias("color"), text.mode_of(F.col("p_size") % 13).alias("mode"),
    )
    label = text.line_label(F.col("id"), F.col("name"), F.col("short_name"), F.col("mode"), LABELS)
    return rows.select("id", "name", "short_name", "color", "mode", label.alias("label"), text.line_letter(F.col("id"), label, LETTERS).alias("letter"), text.ink_on(F.col("color")).alias("ink"))


def _stations(spark: SparkSession, sf_dir: str, statement: str = STATIONS) -> DataFrame:
    return _made(spark, sf_dir, statement).select("name", F.split("raw_names", r"\|").alias("raw_names"))


def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed names to stations; one that two stations have is an error."""
    return timetable.resolve(_made(spark, sf_dir, PRINTED), _stations(spark, sf_dir))


def alias_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of more than one station."""
    return timetable.alias_conflicts(_stations(spark, sf_dir, CONFLICTING))


def stop_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without hints, and stop ids."""
    clean = text.clean_name(F.col("name"))
    return _made(spark, sf_dir, MAP_NAMES).select("name", clean.alias("clean"), text.metro_stop_id(F.col("line"), clean).alias("metro_id"), text.local_stop_id(clean).alias("local_id"))


def station_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight names for each typed prefix, by any word's beginning."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return search.suggestions(search.index(names, "p_name"), _given(spark, PREFIXES))


def suggestion_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1, O2: suggestions from two typed characters on, aliases included."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return search.suggestions(search.index(names, "p_name", _given(spark, ALIASES)), _given(spark, PREFIXES.replace("('w')", "('w'), ('rb'), ('the s')")), search.LEAST_TYPED)


def station_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1, Q1, Q4: every part as a station of its name in one of three spellings, ranked for the beginning of each name, by Unicode's collation, local ones first."""
    stations = _made(spark, sf_dir, SPELLED).withColumn("mode", text.mode_of(F.col("kind")))
    typed = table(spark, sf_dir, "part").select(F.substring("p_name", 1, 3).alias("raw")).distinct()
    return search.ranked_stations(stations, typed)


def rollover_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of one day put back in order past midnight."""
    day = network.day_times(spark, sf_dir)
    return timetable.rolled_over(day.select("trip", "seq", F.pmod("arr", F.lit(1440)).alias("arr"), F.pmod("dep", F.lit(1440)).alias("dep")))


def past_midnight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departures of runs that span 18 hours."""
    day = network.day_times(spark, sf_dir).select("trip", "seq", F.pmod("dep", F.lit(1440)).alias("dep"))
    w = Window.partitionBy("trip")
    return day.select("trip", "seq", timetable.past_midnight(F.col("dep"), F.min("dep").over(w), F.max("dep").over(w)).alias("dep"))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_orderkey").alias("trip"), F.col("l_suppkey").alias("stop"), F.row_number().over(order).cast("long").alias("n"), (F.col("l_partkey") % 1440).alias("minute"))


def run_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as calls; a stop that repeats starts a new run."""
    return timetable.runs(_numbered(spark, sf_dir))


def assemble_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of each customer's orders, from two sources by order priority, folded into trips."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trip"), F.col("o_custkey").alias("train"), F.when(F.col("o_orderpriority") < "3", "a_up").otherwise("b_dn").alias("source"))
    first = Window.partitionBy("trip", "stop").orderBy("n")
    calls = _numbered(spark, sf_dir).withColumn("again", F.row_number().over(first)).where("again = 1")
    rows = calls.join(orders, "trip")
    piece = F.dense_rank().over(Window.partitionBy("train").orderBy("source", "trip")).cast("long")
    return timetable.assemble(rows.select(F.col("train").cast("string").alias("train"), piece.alias("piece"), "source", "n", "stop", "minute"))


def branch_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first branch that a trip has a stop of, else the main line; direction by parity of the trip."""
    hit = network.calls(spark, sf_dir).join(F.broadcast(_given(spark, BRANCHES)), F.col("stop").between(F.col("low"), F.col("high")), "left")
    best = hit.groupBy("trip").agg(F.min_by("branch", F.coalesce("ord", F.lit(99))).alias("branch"))
    return best.select("trip", F.coalesce("branch", F.lit("main")).alias("route"), (F.col("trip") % 2).alias("direction"))


def headway_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headway of an event's line in force at its time; a time in no band is an error."""
    minute = (F.hour("ts") * 60 + F.minute("ts")).cast("long")
    events = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("M"), (1 + F.col("event_id") % 7).cast("string")).alias("line"), minute.alias("minute"))
    rows = events.join(_made(spark, sf_dir, BANDS).withColumnRenamed("line", "of"), (F.col("line") == F.col("of")) & (F.col("minute") >= F.col("start")) & (F.col("minute") < F.col("stop")), "left")
    return rows.select("event_id", "minute", F.coalesce(F.col("minutes").cast("double"), F.raise_error(F.concat(F.lit("no headway at minute "), F.col("minute").cast("string"))).cast("double")).alias("headway"))


def headway_departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departures generated from headways."""
    return timetable.headway_departures(_made(spark, sf_dir, DIRECTIONS), _made(spark, sf_dir, BANDS))


def line_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, pos, offset) of the lines that have headways."""
    return _made(spark, sf_dir, OFFSETS.format(numbers=NUMBERS)).selectExpr("line", "pos", "CAST(offset AS DOUBLE) AS offset")


def metro_stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated trips at each station, both directions."""
    return timetable.metro_stop_times(headway_departures(spark, sf_dir), line_stations(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        invalid_queries, time_parse, time_format, to_hhmm, train_numbers, unpivot_timetable, line_catalog, alias_resolution, alias_conflicts, stop_names, station_search, suggestion_box, station_ranking,
        rollover_fix, past_midnight, run_split, assemble_pieces, branch_route, headway_lookup, headway_departures, metro_stop_times,
    )
}

_N = network.SQL
_NORMAL = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
_ALIASES = f"aliases AS (SELECT DISTINCT {_NORMAL.format('raw')} AS alias, name FROM (SELECT name, unnest(list_concat([name], string_split(raw_names, '|'))) AS raw FROM ({{stations}})))"
_HEADWAYS = f"""WITH RECURSIVE run AS (
  SELECT line, dir, CAST(first AS DOUBLE) AS minute, last FROM ({DIRECTIONS})
  UNION ALL
  SELECT r.line, r.dir, r.minute + CAST(b.minutes AS DOUBLE), r.last FROM run r JOIN ({BANDS}) b ON r.line = b.line AND floor(r.minute) >= b.start AND floor(r.minute) < b.stop WHERE r.minute < r.last
), departures AS (
  SELECT line, dir, minute FROM run WHERE minute < last UNION ALL SELECT line, dir, CAST(last AS DOUBLE) FROM ({DIRECTIONS})
)"""
_FULL = r"'^\s*(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d+)?))?\s*$'"

ORACLE_SQL = {
    "invalid_queries": f"SELECT o_orderkey, raw, coalesce(CASE WHEN regexp_matches(raw, '^\\d{{1,4}}$') THEN TRY_CAST(raw AS INTEGER) < 1440 END, false) AS valid FROM ({MINUTES})",
    "time_parse": "SELECT event_id, CAST(hour(ts) * 60 + minute(ts) AS BIGINT) AS minutes FROM events",
    "time_format": """SELECT o_orderkey, printf('%02d:%02d', (m % 1440) // 60, m % 60) AS clock, printf('%02d:%02d:00', m // 60, m % 60) AS long_clock,
  CASE WHEN m // 60 = 0 THEN printf('%d min', m % 60) WHEN m % 60 = 0 THEN printf('%d h', m // 60) ELSE printf('%d h %02d', m // 60, m % 60) END AS duration, m >= 1440 AS next_day, (m % 1440) AS back,
  CASE WHEN m >= 950 THEN printf('%.1f km', round(m / 1000.0 + 1e-9, 1)) ELSE printf('%d m', CAST(round(m / 10.0) * 10 AS BIGINT)) END AS metres
FROM (SELECT o_orderkey, o_orderkey * 37 % 4320 AS m FROM orders)""",
    "to_hhmm": f"""SELECT o_orderkey, raw, CASE WHEN regexp_matches(raw, {_FULL}) THEN printf('%02d:%02d', (t // 60) % 24, t % 60) END AS time FROM (
  SELECT o_orderkey, raw, TRY_CAST(regexp_extract(raw, {_FULL}, 1) AS BIGINT) * 60 + TRY_CAST(regexp_extract(raw, {_FULL}, 2) AS BIGINT) + CAST(round_even(coalesce(TRY_CAST(regexp_extract(raw, {_FULL}, 3) AS DOUBLE), 0) / 60, 0) AS BIGINT) AS t FROM ({TIMES}))""",
    "train_numbers": f"SELECT p_partkey, cell, array_to_string(regexp_extract_all(string_split(cell, chr(10))[1], '\\b(\\d{{5}}[A-Z]?)\\b', 1), ' ') AS numbers FROM ({HEADERS})",
    "unpivot_timetable": f"""WITH {_N}, x AS (SELECT trip AS sheet, n AS row, trip % 9999 AS k, 'Stop ' || stop AS station, l_partkey % 24 AS h, l_partkey % 60 AS m, l_partkey % 2 = 0 AS two, quantity AS q FROM numbered), t AS (
  SELECT sheet, row, printf('%05d', 90000 + k) AS train_number, station, h * 60 + m AS clock FROM x WHERE row = 3
  UNION ALL SELECT sheet, row, printf('%05d', 60000 + k), station, h * 60 + q + CAST(round_even(m / 60.0, 0) AS BIGINT) FROM x WHERE row = 3
  UNION ALL SELECT sheet, row, printf('%05d', 80000 + k), station, CASE WHEN two THEN h * 60 + m ELSE (h + 2) % 24 * 60 + m END FROM x WHERE row = 3
  UNION ALL SELECT sheet, row, printf('%05d', 70000 + k), station, CASE WHEN two THEN (h + 1) % 24 * 60 + q ELSE (h + 2) % 24 * 60 + m END FROM x WHERE row = 3
  UNION ALL SELECT sheet, row, printf('%05dA', 50000 + k), station, h * 60 + m FROM x WHERE row = 5 OR row > 6
) SELECT sheet, row, train_number, station, printf('%02d:%02d', clock // 60 % 24, clock % 60) AS time FROM t""",
    "line_catalog": """WITH line AS (
  SELECT 'L' || p_partkey AS id, p_name || ' Line' AS name, upper(substr(p_name, 1, 3)) AS short_name, printf('#%06X', (CAST(p_partkey AS BIGINT) * 7919 * 613) % 16777216) AS color, (CAST(p_partkey AS BIGINT) * 7919 * 613) % 16777216 AS c,
    CASE p_size % 13 WHEN 1 THEN 'METRO' WHEN 12 THEN 'MONORAIL' ELSE 'LOCAL' END AS mode FROM part
), lit AS (
  SELECT *, list_transform([c // 65536, c // 256 % 256, c % 256], lambda x: CASE WHEN x / 255.0 <= 0.03928 THEN x / 255.0 / 12.92 ELSE pow((x / 255.0 + 0.055) / 1.055, 2.4) END) AS v FROM line
), named AS (
  SELECT *, 0.2126 * v[1] + 0.7152 * v[2] + 0.0722 * v[3] + 0.05 AS l, CASE WHEN mode <> 'LOCAL' THEN short_name WHEN id = 'L2' THEN 'Second' WHEN id = 'L5' THEN 'Fifth' ELSE regexp_replace(name, ' Line$', '') END AS label FROM lit
) SELECT id, name, short_name, color, mode, label, CASE id WHEN 'L3' THEN 'X' WHEN 'L5' THEN 'V' ELSE substr(label, 1, 1) END AS letter, CASE WHEN l / 0.0598 > 1.05 / l THEN '#0C1A26' ELSE '#FFFFFF' END AS ink FROM named""",
    "alias_resolution": f"WITH {_ALIASES.format(stations=STATIONS)} SELECT c_custkey, station, name FROM ({PRINTED}) LEFT JOIN aliases ON alias = {_NORMAL.format('station')}",
    "alias_conflicts": f"WITH {_ALIASES.format(stations=CONFLICTING)} SELECT alias, count(*) AS names FROM aliases GROUP BY alias HAVING count(*) > 1",
    "stop_names": f"""SELECT name, clean, line || '_' || trim(regexp_replace(upper(clean), '[^A-Z0-9]+', '_', 'g'), '_') AS metro_id, upper(replace(clean, ' ', '_')) AS local_id FROM (
  SELECT line, name, trim(regexp_replace(regexp_replace(regexp_replace(name, '\\s*\\[[^\\]]*\\]', '', 'g'), '\\s*\\((Line \\w+|eastbound|westbound)\\)', '', 'g'), '\\s+', ' ', 'g')) AS clean FROM ({MAP_NAMES}))""",
    "station_search": f"""WITH names AS (SELECT DISTINCT p_name AS name FROM part), typed AS (SELECT raw, replace(replace(lower(substr(trim(raw), 1, 60)), '''', ''), '.', '') AS prefix FROM {PREFIXES}), hits AS (
  SELECT raw, name, starts_with(replace(replace(lower(name), '''', ''), '.', ''), prefix) AS first FROM typed, names
  WHERE len(list_filter(range(len(string_split(name, ' '))), lambda i: starts_with(replace(replace(lower(array_to_string(string_split(name, ' ')[i + 1:], ' ')), '''', ''), '.', ''), prefix))) > 0
) SELECT raw, name, rank FROM (SELECT raw, name, row_number() OVER (PARTITION BY raw ORDER BY first DESC, name) AS rank FROM hits) WHERE rank <= 8""",
    "suggestion_box": f"""WITH names AS (SELECT DISTINCT p_name AS name FROM part), typed AS (SELECT raw, translate(lower(substr(trim(raw), 1, 60)), chr(39) || '.', '') AS prefix FROM {PREFIXES.replace("('w')", "('w'), ('rb'), ('the s')")} WHERE length(trim(raw)) >= 2), hits AS (
  SELECT raw, name, starts_with(lower(name), prefix) AS first FROM typed, names
  WHERE len(list_filter(range(len(string_split(name, ' '))), lambda i: starts_with(lower(array_to_string(string_split(name, ' ')[i + 1:], ' ')), prefix))) > 0
     OR EXISTS (SELECT 1 FROM {ALIASES.replace('AS t(', 'AS al(')} WHERE al.name = names.name AND starts_with(al.alias, prefix))
) SELECT raw, name, rank FROM (SELECT raw, name, row_number() OVER (PARTITION BY raw ORDER BY first DESC, name) AS rank FROM hits) WHERE rank <= 8""",
    "station_ranking": f"""WITH stations AS (SELECT id, name, lower(name) AS form, CASE kind WHEN 1 THEN 'METRO' WHEN 12 THEN 'MONORAIL' ELSE 'LOCAL' END AS mode FROM ({SPELLED})), hits AS (
  SELECT raw, s.*, starts_with(form, raw) AS first FROM stations s, (SELECT DISTINCT substr(p_name, 1, 3) AS raw FROM part) WHERE starts_with(form, raw) OR contains(form, ' ' || raw)
) SELECT raw, id, name, mode, row_number() OVER (PARTITION BY raw ORDER BY NOT first, name COLLATE en, mode <> 'LOCAL', id) AS rank FROM hits""",
    "rollover_fix": f"""WITH RECURSIVE {_N}, day AS MATERIALIZED (SELECT trip, seq, arr % 1440 AS arr, dep % 1440 AS dep FROM day_time), fixed AS (
  SELECT trip, seq, arr, dep + CASE WHEN dep < arr THEN 1440 ELSE 0 END AS dep, CAST(0 AS BIGINT) AS extra FROM day WHERE seq = 1
  UNION ALL
  SELECT d.trip, d.seq, d.arr + e, d.dep + e + CASE WHEN d.dep < d.arr THEN 1440 ELSE 0 END, e FROM (
    SELECT d.*, f.extra + CASE WHEN d.arr + f.extra < f.dep - 60 THEN 1440 ELSE 0 END AS e FROM fixed f JOIN day d ON d.trip = f.trip AND d.seq = f.seq + 1) d
) SELECT trip, seq, arr, dep FROM fixed""",
    "past_midnight": f"WITH {_N}, day AS (SELECT trip, seq, dep % 1440 AS dep FROM day_time) SELECT trip, seq, dep + CASE WHEN max(dep) OVER w // 60 - min(dep) OVER w // 60 >= 18 AND dep < 720 THEN 1440 ELSE 0 END AS dep FROM day WINDOW w AS (PARTITION BY trip)",
    "run_split": f"""WITH RECURSIVE {_N}, folded AS (
  SELECT trip, n, stop, CAST(0 AS BIGINT) AS run, [stop] AS seen FROM numbered WHERE n = 1
  UNION ALL
  SELECT x.trip, x.n, x.stop, f.run + CAST(list_contains(f.seen, x.stop) AS BIGINT), CASE WHEN list_contains(f.seen, x.stop) THEN [x.stop] ELSE list_append(f.seen, x.stop) END FROM folded f JOIN numbered x ON x.trip = f.trip AND x.n = f.n + 1
) SELECT trip, n, stop, run FROM folded""",
    "branch_route": f"WITH {_N} SELECT trip, coalesce(arg_min(branch, ord), 'main') AS route, trip % 2 AS direction FROM call LEFT JOIN {BRANCHES.replace('AS t(', 'AS b(')} ON stop BETWEEN low AND high GROUP BY trip",
    "headway_lookup": f"SELECT event_id, CAST(hour(ts) * 60 + minute(ts) AS BIGINT) AS minute, CAST(minutes AS DOUBLE) AS headway FROM events JOIN ({BANDS}) ON line = 'M' || (1 + event_id % 7) AND hour(ts) * 60 + minute(ts) >= start AND hour(ts) * 60 + minute(ts) < stop",
    "headway_departures": f"{_HEADWAYS} SELECT line, dir, minute FROM departures",
    "metro_stop_times": f"""{_HEADWAYS}, placed AS (SELECT line, pos, CAST("offset" AS DOUBLE) AS o, CAST(max("offset") OVER (PARTITION BY line) AS DOUBLE) AS total, count(*) OVER (PARTITION BY line) AS stations FROM ({OFFSETS.replace('AS offset', 'AS "offset"').format(numbers=NUMBERS)}))
SELECT printf('%s-%d-%02d%02d', line, dir, CAST(floor(minute) AS BIGINT) // 60, CAST(floor(minute) AS BIGINT) % 60) AS trip_id, CASE WHEN dir = 0 THEN pos + 1 ELSE stations - pos END AS seq, CAST(round_even(minute + CASE WHEN dir = 0 THEN o ELSE total - o END, 0) AS BIGINT) AS minute FROM departures JOIN placed USING (line)""",
}
