"""Helpers that several corpus operators share: staged tables, skew-safe joins, word rules."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space (bytes.split() cuts UTF-8 at exactly these bytes).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
#: A group that holds this share of all rows or more is broadcast, so at most 1 / HOT_SHARE groups are.
HOT_SHARE = 0.001


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where it is unset, only a single-machine session gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.webinsight.stage.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="webinsight-stage-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.webinsight.stage.dir", found)
    return found


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor costs only its own tasks."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def crc_fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Left join of one group row onto each of its rows, safe when one group holds a third of them.

    groups: unique non-null keys, with the number of its rows in `weight`. Groups of HOT_SHARE of the rows or more
    number 1000 at most and are broadcast; each of the others is small, so the shuffled join has no hot key.
    """
    line = max(1.0, total * HOT_SHARE)
    hot = F.broadcast(groups.filter(F.col(weight) >= line))
    rest = groups.filter(F.col(weight) < line)
    by_hot = rows.join(hot, keys)
    by_rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, "left")
    return by_hot.unionByName(by_rest)


def without(docs: DataFrame, lost: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """docs whose key isn't in lost (unique, non-null keys; `weight`: how many of docs' `total` rows have the key). Keys with many
    rows, 1000 at most, are broadcast. How many others there are has no bound: both sides are dealt by the key, and the hash table
    is built on lost, so texts are moved once and aren't sorted."""
    line = max(2.0, total * HOT_SHARE)
    hot, rest = lost.filter(F.col(weight) >= line).select(key), lost.filter(F.col(weight) < line).select(key)
    return docs.join(F.broadcast(hot), key, "left_anti").join(rest.hint("shuffle_hash"), key, "left_anti")


def one_of_each(docs: DataFrame, marks: DataFrame, mark: Column, total: int) -> DataFrame:
    """The rows of docs that stay, all columns. mark: a non-null string of a row's id and content; marks (mark, n, n_kept), unique: how
    many of docs' `total` rows have it, and how many of these stay, one at most."""
    lost = stage(marks.filter("n > n_kept").withColumnRenamed("mark", "__mark"), "lost-marks")
    marked = docs.withColumn("__mark", mark)
    out = without(marked, lost, "__mark", "n", total)
    again = lost.filter("n_kept > 0")
    if not again.isEmpty():  # repeated rows: one of them stays
        out = out.unionByName(rows_marked(marked, again, total).dropDuplicates(["__mark"]))
    return out.select(*docs.columns)


def rows_marked(marked: DataFrame, again: DataFrame, total: int) -> DataFrame:
    """Rows whose mark is in again; marks with many rows are broadcast, the others shuffled."""
    line = max(2.0, total * HOT_SHARE)
    hot, rest = F.broadcast(again.filter(F.col("n") >= line).select("__mark")), again.filter(F.col("n") < line).select("__mark")
    first = marked.join(hot, "__mark", "left_semi")
    return first.unionByName(marked.join(hot, "__mark", "left_anti").join(rest, "__mark", "left_semi"))
