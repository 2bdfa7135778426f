"""Change feeds: events (ts, event_id, path, op) become index passes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moved(events: DataFrame) -> DataFrame:
    """A move (path, dest) is a deletion and a creation."""
    old = events.withColumn("op", F.when(F.col("op") == "moved", "deleted").otherwise(F.col("op")))
    new = events.filter("op = 'moved'").withColumn("path", F.col("dest")).withColumn("op", F.lit("created"))
    return old.unionByName(new)


def last_changes(events: DataFrame, by: list[str | Column] = ()) -> DataFrame:
    """Of each path the last operation (by time, then event_id) and how many there were."""
    return events.groupBy(*by, "path").agg(F.max_by("op", F.struct("ts", "event_id")).alias("op"), F.max("ts").alias("ts"), F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Debounced passes: runs of events with no gap longer than `gap`. Batch and streaming (with a watermark)."""
    s = F.session_window("ts", gap)
    return events.groupBy(s).agg(F.count("*").alias("n_events"), F.max("ts").alias("last_ts")).select(F.col("session_window.start").alias("first_ts"), "last_ts", "n_events")


def debounced(events: DataFrame, gap_seconds: int, span: str = "1 day") -> DataFrame:
    """sessions() of a stored feed without one task for all of it: sessions within spans of time, in parallel;
    then only the first and last session of each span are put in order and joined over the spans' ends."""
    gap = F.expr(f"INTERVAL '{int(gap_seconds)}' SECOND")
    far = lambda a, b: F.coalesce(a - b > gap, F.lit(True)).cast("int")
    order = Window.partitionBy("span").orderBy("ts", "event_id")
    d = events.filter("ts is not null").select("ts", "event_id", F.window("ts", span)["start"].alias("span"))
    d = d.withColumn("new", far(F.col("ts"), F.lag("ts").over(order))).withColumn("s", F.sum("new").over(order))
    d = d.groupBy("span", "s").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_events"))
    w = Window.partitionBy("span")
    d = d.withColumn("edge", (F.col("s") == F.min("s").over(w)) | (F.col("s") == F.max("s").over(w)))
    line = Window.orderBy("first_ts")  # two rows for each span at most
    ends = d.filter("edge").withColumn("g", far(F.col("first_ts"), F.lag("last_ts").over(line))).withColumn("g", F.sum("g").over(line))
    joined = ends.groupBy("g").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n_events").alias("n_events"))
    return d.filter("not edge").select("first_ts", "last_ts", "n_events").unionByName(joined.drop("g"))


def windowed(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by time window and operation."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.groupBy(w, "op").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("window_start"), "op", "n", "total")


def watch(events: DataFrame, apply: Callable[[DataFrame, DataFrame], None], checkpoint: str, ignored: Column | None = None, every: str = "10 seconds", once: bool = False):
    """Start a query that hands each micro-batch's changes to apply(dirty, deleted), a path in one of them.

    A batch that is run again hands over the same paths; apply must be idempotent (upserts and
    anti-joins are).
    """
    feed = events if ignored is None else events.filter(~ignored)

    def step(batch: DataFrame, _: int) -> None:
        last = last_changes(batch).persist()
        try:
            apply(last.filter("op <> 'deleted'").select("path"), last.filter("op = 'deleted'").select("path"))
        finally:
            last.unpersist()

    w = feed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()
