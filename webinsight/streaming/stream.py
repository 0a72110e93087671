"""Structured Streaming jobs: drop-folder ingest, completeness, late dates, tripwires, hourly hits, action sessions, file dedupe."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webinsight.operators import logs as L
from webinsight.operators.common import stage, stage_observed
from webinsight.sources import logs as SL
from webinsight.sources.sinks import overwrite_dates


def event_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def run_now(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None, path: str | None = None, mode: str = "append") -> int:
    """Process what is there and end: the stream's own checkpoint remembers which files are done, and the state of open groups.
    Returns how many late groups the watermark dropped."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(each).start() if each else w.format("parquet").option("path", path).start()
    q.awaitTermination()
    return sum(s.numRowsDroppedByWatermark for p in q.recentProgress for s in p.stateOperators)


class TripwireError(RuntimeError):
    """A batch that must not be written."""


def check_tripwires(n: int, known: int, most_without_known: int = 100_000) -> None:
    """Refuse an empty batch, and one with many hits of which none is known."""
    if not n:
        raise TripwireError("no lines")
    if n > most_without_known and not known:
        raise TripwireError(f"{n} hits, none of a known URL")


def gated(hits: DataFrame, most_without_known: int = 100_000) -> tuple[DataFrame, dict[str, int]]:
    """hits, written, with their metrics, gathered in the same pass; raises where they must not be published."""
    rows, got = stage_observed(hits, "gated-hits", hits=F.count("*"), known=F.count_if("is_known_url"))
    check_tripwires(got["hits"], got["known"], most_without_known)
    return rows, got


def log_stream(spark: SparkSession, drop: str, archive: str | None = None) -> DataFrame:
    """Lines of the files that arrive in the drop folder, with their file. With an archive, a file moves there after its batch."""
    r = spark.readStream.format("text").option("recursiveFileLookup", "true")
    if archive:
        spark.conf.set("spark.sql.streaming.fileSource.cleaner.numThreads", "0")  # moved within the commit, not beside the next batch
        r = r.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return r.load(drop).select("value", F.col("_metadata.file_path").alias("file"))


def rebuild_dates(spark: SparkSession, landing: str, dates: list[str], catalog: DataFrame, ranges: DataFrame, target: str, ledger: str, expected: int = 1) -> None:
    """The cube and the ledger of whole dates, from every file that the manifest has of them; other dates stay as they are.

    A file without a required field counts as failed, and its lines don't enter the cube. Nothing is written where the
    tripwires hold the lines back, and running it again gives the same tables.
    """
    lines = SL.read_dates(spark, landing, dates).withColumn("log_date", F.to_date("log_date"))
    files = stage(SL.file_facts(lines), "log-files")
    # Lines are parsed once, into columns: what follows reads them several times, and few columns each time.
    parsed = stage(SL.parse_lines(lines, files.filter("not failed").select("file", "fields")).drop("file", "short"), "parsed-lines")
    hits = L.verify_ips(L.with_membership(L.parse_hits(parsed), catalog), ranges)
    cube, got = stage_observed(L.build_cube(hits), "gated-cube", hits=F.sum("hits"), known=F.sum(F.when(F.col("is_known_url"), F.col("hits"))))
    check_tripwires(got["hits"] or 0, got["known"] or 0)
    books = files.groupBy("log_date").agg(
        F.count("*").alias("files"), F.sum("lines").alias("raw_lines"), F.count_distinct(SL.file_hour(F.col("file"))).alias("hours_present"), F.count_if("failed").alias("failed_files")
    )
    kept = cube.groupBy("log_date").agg(F.sum("hits").alias("bot_lines"), F.sum(F.when(F.col("is_known_url"), F.col("hits"))).alias("known_rows"))
    books = books.join(kept, "log_date", "left").na.fill(0).withColumn("expected_files", F.lit(expected).cast("long"))
    overwrite_dates(cube, target)
    overwrite_dates(books.withColumn("is_complete", L.ledger_complete()), ledger)


def ingest(spark: SparkSession, drop: str, archive: str, catalog: DataFrame, ranges: DataFrame, target: str, ledger: str, checkpoint: str, expected: int = 1, landing: str | None = None) -> None:
    """Read what has arrived. A batch lands its lines, which tells the dates that have new files; each of these is rebuilt whole from
    all batches that its manifest names, so a late file, a second batch or a replay of one never loses lines of its date."""
    landing = landing or f"{ledger}-landing"

    def each(batch: DataFrame, number: int) -> None:
        if dates := SL.land(batch, landing, number):
            rebuild_dates(spark, landing, dates, catalog, ranges, target, ledger, expected)

    run_now(log_stream(spark, drop, archive), checkpoint, each)


def hours_seen(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Tumbling hours that hold data, for the completeness gate; one row an hour."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("lines")).select(F.col("w.start").alias("hour"), "lines")


def complete_dates(hours: DataFrame) -> DataFrame:
    """Dates of which all 24 hours have data."""
    return hours.groupBy(F.to_date("hour").alias("log_date")).agg(F.count_distinct("hour").alias("hours"), F.sum("lines").alias("lines")).withColumn("complete", F.col("hours") == 24)


def hourly_hits(stream: DataFrame, late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Hits by hour and event type."""
    w = F.window("ts", "1 hour", slide) if slide else F.window("ts", "1 hour")
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("hits")).select(F.col("w.start").alias("hour"), "event_type", "hits")


def action_sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user's actions, split where more than the gap passes without one."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("actions")).select("user_id", F.col("w.start").alias("started_at"), "actions")


def dedupe_files(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Files (name, ts) once each by base name, across drop folders, within the watermark."""
    return stream.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).withWatermark("ts", late).dropDuplicatesWithinWatermark(["name"])


def fresh_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Batch twin: files whose base name isn't in the ledger yet, one path a name."""
    rows = files.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).groupBy("name").agg(F.min("path").alias("path"))
    return rows.join(ledger.select("name"), "name", "left_anti")
