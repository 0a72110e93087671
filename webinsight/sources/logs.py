"""Access logs: header-declared TSV files, and their discovery by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Required log fields and the column each becomes.
FIELDS = {"cs(User-Agent)": "ua", "x-host-header": "host", "cs-uri-stem": "path", "sc-status": "status", "x-edge-result-type": "edge_result", "sc-bytes": "bytes", "time-taken": "time_taken", "c-ip": "ip"}
FILE_NAME = r"([^/]+)\.(\d{4}-\d{2}-\d{2})-(\d{2})\.[^./]+(?:\.gz)?$"


def headers(lines: DataFrame) -> DataFrame:
    """(file, fields): the #Fields headers of lines (value, file)."""
    return lines.filter(F.col("value").startswith("#Fields:")).select("file", F.split(F.trim(F.substring("value", 9, 1 << 20)), "[ \t]+").alias("fields"))


def lacking(fields: Column) -> Column:
    """The required fields that a header lacks; all of them where there is no header."""
    return F.array_except(F.array(*map(F.lit, FIELDS)), F.coalesce(fields, F.array().cast("array<string>")))


def is_data(value: Column) -> Column:
    return ~value.startswith("#") & (value != "")


def parse_lines(lines: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """lines (value, file, and what else there is) -> the required columns, by each file's own #Fields header, or by heads (file, fields),
    one row a file. Comments are skipped; short rows give nulls and short = true. Works on batches of a stream as well."""
    if heads is None:
        heads = headers(lines).groupBy("file").agg(F.first("fields").alias("fields"))
    rows = lines.filter(is_data(F.col("value"))).withColumn("v", F.split("value", "\t")).join(heads, "file")
    cell = lambda name: F.try_element_at("v", F.nullif(F.array_position("fields", name).cast("int"), F.lit(0)))
    others = [c for c in lines.columns if c not in ("value", "file")]
    return rows.select("file", *others, *(cell(k).alias(c) for k, c in FIELDS.items()), (F.size("v") < F.size("fields")).alias("short"))


def missing_fields(lines: DataFrame) -> DataFrame:
    """Files whose header lacks a required field (or that have no header)."""
    return lines.select("file").distinct().join(headers(lines), "file", "left").select("file", lacking(F.col("fields")).alias("missing")).filter(F.size("missing") > 0)


def file_facts(lines: DataFrame) -> DataFrame:
    """One row a file of lines (value, file, log_date): its data lines, its header, and whether a required field is missing there."""
    heads = headers(lines).groupBy("file").agg(F.min("fields").alias("fields"), F.bool_or(F.size(lacking(F.col("fields"))) > 0).alias("failed"))
    counts = lines.groupBy("file", "log_date").agg(F.count_if(is_data(F.col("value"))).alias("lines"))
    return counts.join(heads, "file", "left").na.fill(True, ["failed"])


def _in_name(path: Column, group: int) -> Column:
    """A group of FILE_NAME, sought in the name alone and from its start: in a whole path it is tried at each letter."""
    return F.nullif(F.regexp_extract(F.substring_index(path, "/", -1), f"^{FILE_NAME}", group), F.lit(""))


def file_date(path: Column) -> Column:
    """A file's date by its name, else by its log_date= folder."""
    return F.coalesce(_in_name(path, 2), F.nullif(F.regexp_extract(path, r"log_date=(\d{4}-\d{2}-\d{2})", 1), F.lit("")))


def file_hour(path: Column) -> Column:
    return F.coalesce(_in_name(path, 3), F.nullif(F.regexp_extract(path, r"hour=(\d{1,2})", 1), F.lit(""))).cast("int")


def base_name(path: Column) -> Column:
    """What tells one log file from another, in whatever folder it lies: from its log_date= folder on, else the name alone."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"(log_date=.*)$", 1), F.lit("")), F.regexp_extract(path, r"([^/]+)$", 1))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"))


def land(lines: DataFrame, landing: str, batch: int) -> list[str]:
    """Take a batch's lines (value, file) over into the landing folder, and note its files in the manifest of their dates; the dates.

    Lines lie at lines/batch=/log_date=, files at manifest/log_date=/batch=, so a date's manifest names all that has to be read for it.
    A batch that comes again replaces itself. Files without a date in their name are left out.
    """
    spark = lines.sparkSession
    mine = f"{landing}/lines/batch={batch}"
    dated = lines.select("value", "file", file_date(F.col("file")).alias("log_date")).filter(F.col("log_date").isNotNull())
    # A date's lines go to a few tasks, by file, so that a batch of very many small files leaves few.
    dealt = dated.repartition("log_date", F.pmod(F.xxhash64("file"), F.lit(4)))
    dealt.write.mode("overwrite").partitionBy("log_date").parquet(mine)
    schema = "value string, file string, log_date string"
    files = spark.read.schema(schema).parquet(mine).groupBy("log_date", "file").agg(F.count("*").alias("n_lines"))
    files = files.select("file", base_name(F.col("file")).alias("name"), "n_lines", "log_date", F.lit(batch).cast("bigint").alias("batch"))
    files.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("log_date", "batch").parquet(f"{landing}/manifest")
    return sorted(r[0] for r in spark.read.schema(schema).parquet(mine).select("log_date").distinct().collect())


def read_dates(spark: SparkSession, landing: str, dates: list[str]) -> DataFrame:
    """Lines (value, file, log_date) of the dates' files, each base name from its first batch. Folders of other dates are neither
    listed nor opened."""
    manifest = f"{landing}/manifest"
    books = spark.read.schema("file string, name string, n_lines bigint, log_date string, batch bigint").option("basePath", manifest).parquet(*(f"{manifest}/log_date={d}" for d in dates))
    first = books.groupBy("log_date", "name").agg(F.min(F.struct("batch", "file")).alias("b")).select("log_date", "b.batch", "b.file")
    found = sorted((r["log_date"], r["batch"]) for r in books.select("log_date", "batch").distinct().collect())
    lines = f"{landing}/lines"
    rows = spark.read.schema("value string, file string, batch bigint, log_date string").option("basePath", lines).parquet(*(f"{lines}/batch={b}/log_date={d}" for d, b in found))
    return rows.join(first, ["log_date", "batch", "file"], "left_semi").select("value", "file", "log_date")


def write_access_logs(rows: DataFrame, path: str, keys: list[str], salts: int = 4, most: int = 250_000) -> None:
    """rows (keys, line) as text files below key= folders, each with the required header. Lines stay rows: where a folder has more than
    `most` lines, each folder's are dealt over up to `salts` tasks, so no folder is gathered in one value or task."""
    head = "#Version: 1.0\n#Fields: " + " ".join(FIELDS) + "\n"
    largest = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    salt = F.pmod(F.xxhash64("line"), F.lit(max(1, min(salts, -(-largest // most)))))
    dealt = rows.select(*keys, F.col("line").alias("value"), salt.alias("salt")).repartition(*keys, "salt")
    first = F.row_number().over(Window.partitionBy(*keys, "salt").orderBy("salt")) == 1
    out = dealt.withColumn("value", F.when(first, F.concat(F.lit(head), F.col("value"))).otherwise(F.col("value")))
    out.select(*keys, "value").write.mode("append").partitionBy(*keys).text(path)


def read_access_logs(spark: SparkSession, path: str) -> DataFrame:
    """Raises where a file lacks a required field."""
    lines = read_lines(spark, path)
    if bad := missing_fields(lines).limit(5).collect():
        raise ValueError(f"log files without required fields: {[(r['file'], r['missing']) for r in bad]}")
    return parse_lines(lines)


def discover(files: DataFrame) -> DataFrame:
    """files (path): per date the distributions, hours, folders and number of files; equal base names count once."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = files.withColumns({"name": name, "dist": F.regexp_extract("path", FILE_NAME, 1), "log_date": F.regexp_extract("path", FILE_NAME, 2), "hour": F.regexp_extract("path", FILE_NAME, 3), "folder": F.regexp_extract("path", r"^(.*)/[^/]+$", 1)})
    rows = rows.filter("log_date <> ''").groupBy("name", "log_date", "hour", "dist").agg(F.min("folder").alias("folder"))
    return rows.groupBy("log_date").agg(F.count("*").alias("files"), F.count_distinct("hour").alias("hours"), F.count_distinct("dist").alias("dists"), F.count_distinct("folder").alias("folders"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of all files below; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
