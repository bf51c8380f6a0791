"""A timetable network derived from the order tables, and the same in SQL.

A supplier is a stop, an order a trip, its line items the calls. All of both
everything is integer arithmetic, so that any engine gets the same network.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.sources.shared import dealt, table

#: Shared head of SQL statements over the network: calls, stop_time (two days), walk, stops and request.
SQL = """
numbered AS (
  SELECT l_orderkey AS trip, l_suppkey AS stop, l_partkey, CAST(l_quantity AS BIGINT) AS quantity,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS n
  FROM lineitem
), first_calls AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trip, stop ORDER BY n) AS again FROM numbered) WHERE again = 1
), call AS (
  SELECT * FROM (
    SELECT trip, stop, l_partkey, quantity, row_number() OVER (PARTITION BY trip ORDER BY n) AS seq, count(*) OVER (PARTITION BY trip) AS calls FROM first_calls
  ) WHERE calls > 1
), day_time AS (
  SELECT trip, stop, seq, dep - quantity % 2 AS arr, dep FROM (
    SELECT *, (trip * 7919) % 1440 + CAST(sum(CASE WHEN seq = 1 THEN 0 ELSE 3 + l_partkey % 12 END + quantity % 2) OVER (PARTITION BY trip ORDER BY seq) AS BIGINT) AS dep FROM call
  )
), stop_time AS MATERIALIZED (
  SELECT trip * 2 + d AS trip, stop, seq, arr + 1440 * d AS arr, dep + 1440 * d AS dep FROM day_time, (VALUES (0), (1)) AS days(d)
), stops AS (
  SELECT s_suppkey AS stop, s_nationkey AS line FROM supplier
), walk AS MATERIALIZED (
  SELECT a.stop AS a, b.stop AS b, 2 + (a.stop * b.stop) % 13 AS minutes FROM stops a JOIN stops b ON b.stop BETWEEN a.stop - 6 AND a.stop + 6 AND a.stop <> b.stop AND (a.stop + b.stop) % 11 = 0
), size AS (
  SELECT count(*) AS n FROM supplier
), request AS (
  SELECT CAST(n_nationkey AS BIGINT) AS q, (n_nationkey * 13) % n AS src, (n_nationkey * 29 + 7) % n AS dst, (n_nationkey * 37) % 1440 AS t0 FROM nation, size
)
"""


def _numbered_calls(spark: SparkSession, sf_dir: str, only: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """The columns of calls, and n, by which the rows lie in order within their trips; only: the trips (trip) that are wanted, before anything is dealt; whole: no shuffle tasks are put together."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("trip"), F.col("l_suppkey").cast("long").alias("stop"), *order)
    if only is not None:
        rows = rows.join(only, "trip", "left_semi")
    if whole:
        rows = dealt(rows, "trip")
    trip = Window.partitionBy("trip")
    rows = rows.withColumn("n", F.row_number().over(trip.orderBy(*order)))
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("trip", "stop").orderBy("n"))).where("again = 1")
    rows = rows.withColumns({"seq": F.row_number().over(trip.orderBy("n")).cast("long"), "calls": F.count("*").over(trip)}).where("calls > 1")
    return rows.select("trip", "stop", F.col("l_partkey").cast("long").alias("l_partkey"), F.col("l_quantity").cast("long").alias("quantity"), "seq", "n")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trip, stop, l_partkey, quantity, seq): one call for each trip and stop, the first; trips of two calls at least. One shuffle, by trip."""
    return _numbered_calls(spark, sf_dir).drop("n")


def day_times(spark: SparkSession, sf_dir: str, only: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """(trip, stop, seq, arr, dep) of the first day, in minutes, dealt by trip and in order of its calls: no shuffle or sort by trip follows.

    only: the trips (trip) that are wanted; all if None. whole: see _numbered_calls.
    """
    hop = F.when(F.col("seq") == 1, 0).otherwise(3 + F.col("l_partkey") % 12) + F.col("quantity") % 2
    dep = (F.col("trip") * 7919) % 1440 + F.sum(hop).over(Window.partitionBy("trip").orderBy("n"))
    timed = _numbered_calls(spark, sf_dir, only, whole).withColumn("dep", dep)
    return timed.select("trip", "stop", "seq", (F.col("dep") - F.col("quantity") % 2).alias("arr"), "dep")


@contextmanager
def kept_day(spark: SparkSession, sf_dir: str) -> Iterator[DataFrame]:
    """day_times for jobs that pass over it many times: made once and kept on the executors' disks, dealt by trip and in order of seq, which a written table would not tell.

    What is lost with an executor is made again from the tables.
    """
    day = day_times(spark, sf_dir, whole=True).sortWithinPartitions("trip", "seq").persist(StorageLevel.DISK_ONLY)
    try:
        # how its rows are dealt is known to plans once it is there
        day.count()
        yield day
    finally:
        day.unpersist()


def next_day(day: DataFrame) -> DataFrame:
    """Every trip again a day later: 48 hours, no trip of the day before."""
    rows = day.withColumn("d", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.select((F.col("trip") * 2 + F.col("d")).alias("trip"), "stop", "seq", *((F.col(c) + 1440 * F.col("d")).alias(c) for c in ("arr", "dep")))


def stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_day(day_times(spark, sf_dir))


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("stop"), F.col("s_nationkey").cast("long").alias("line"))


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, minutes), directed: an equi join over the thirteen neighbours in number, not a product."""
    here = stops(spark, sf_dir).select(F.col("stop").alias("a"))
    near = here.select("a", F.explode(F.sequence(F.col("a") - 6, F.col("a") + 6)).alias("b")).where((F.col("a") != F.col("b")) & ((F.col("a") + F.col("b")) % 11 == 0))
    return near.join(here.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b", (2 + (F.col("a") * F.col("b")) % 13).alias("minutes"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, src, dst, t0): one for each nation."""
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    k = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").join(F.broadcast(n)).select(k.alias("q"), ((k * 13) % F.col("n")).alias("src"), ((k * 29 + 7) % F.col("n")).alias("dst"), ((k * 37) % 1440).alias("t0"))
