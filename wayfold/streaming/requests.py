"""Requests as a stream of lines, id|from,to,minutes, answered in micro-batches by the batch router."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayfold.operators import analytics, routing
from wayfold.sources.shared import written


def parsed(lines: DataFrame) -> DataFrame:
    """(id, src, dst, t0, error) of lines (value): both stops numbers, minutes one to four digits below 1440."""
    head = F.split("value", r"\|", 2)
    parts = F.split(F.get(head, F.lit(1)), ",")
    minutes = F.get(parts, F.lit(2))
    t0 = F.when(minutes.rlike(r"^\d{1,4}$"), minutes.try_cast("long"))
    rows = lines.select(head[0].alias("id"), F.get(parts, F.lit(0)).try_cast("long").alias("src"), F.get(parts, F.lit(1)).try_cast("long").alias("dst"), F.when(t0 < 1440, t0).alias("t0"), F.size(parts).alias("n"))
    good = F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("t0").isNotNull() & (F.col("n") == 3)
    return rows.select("id", "src", "dst", "t0", F.when(~good, "bad request").alias("error"))


def answer(lines: DataFrame, stop_times: DataFrame, walks: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((id, line), (src, dst, t0, body)): an answer to every line, and the bodies that are new.

    Equal requests are routed once; those whose body is known (src, dst, t0,
    body) aren't routed again and say that they come from there. Errors are not
    kept.
    """
    asked = written(parsed(lines), "asked")
    good = asked.where("error IS NULL")
    once = good.select("src", "dst", "t0").distinct()
    if known is not None:
        known = known.join(once, ["src", "dst", "t0"], "left_semi")
        once = once.join(known, ["src", "dst", "t0"], "left_anti")
    once = written(once.withColumn("q", F.xxhash64("src", "dst", "t0")), "once")
    labels = routing.labels(once, stop_times, walks)
    routed = analytics.answers(once, routing.legs(once, labels, stop_times)).join(once, "q")
    new = written(routed.select("src", "dst", "t0", F.regexp_extract("line", r"^[^|]*\|(.*)$", 1).alias("body")), "answers")
    bodies = new
    if known is not None:
        bodies = new.unionByName(known.withColumn("body", F.regexp_replace("body", r"^\{\"cached\":false", '{"cached":true')))
    fine = good.join(bodies, ["src", "dst", "t0"]).select("id", F.concat("id", F.lit("|"), F.col("body")).alias("line"))
    bad = asked.where("error IS NOT NULL").select("id", F.concat("id", F.lit("|"), F.to_json(F.struct("error"))).alias("line"))
    return fine.unionByName(bad), new


def serve(lines: DataFrame, stop_times: DataFrame, walks: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Answer a stream of lines into a folder of Parquet files, one folder a batch, so that a batch that runs again replaces its own.

    What a batch has routed is kept beside the stream's checkpoint, also by
    batch. A later batch looks up the requests that it holds there, by a join,
    and routes the others; a batch that runs again sees those before it only.
    """
    spark = lines.sparkSession
    kept = f"{checkpoint.rstrip('/')}-answers"

    def one_batch(batch: DataFrame, number: int) -> None:
        known = spark.read.schema("src long, dst long, t0 long, body string, batch long").option("basePath", kept).parquet(kept).where(F.col("batch") < number).drop("batch") if number else None
        found, new = answer(batch, stop_times, walks, known)
        new.write.mode("overwrite").parquet(f"{kept}/batch={number}")
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return lines.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
