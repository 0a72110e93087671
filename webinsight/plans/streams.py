"""Queries of sources, sinks and streaming jobs, over files that Spark derives from the tables."""

from pyspark.sql import functions as F

from webinsight.functions.sqlfuncs import register_sql
from webinsight.operators import logs as L
from webinsight.operators.common import stage
from webinsight.sources import logs as SL
from webinsight.sources import sinks, uploads
from webinsight.sources.work import work_path
from webinsight.streaming import stream as ST

from .logs import _CUBE, _FULL
from .registry import query

def log_lines(t):
    """v_hits as lines of log files: log_date, hour, host, line, event_id."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("ua", "host", "path", "status", "edge_result", "bytes", "time_taken", "ip")]
    return t("v_hits").select("log_date", F.hour("ts").alias("hour"), F.col("host").alias("dist"), F.concat_ws("\t", *cells).alias("line"), "event_id")


def written_logs(t):
    """v_hits as header-declared log files, by date, hour and host."""
    path = work_path(t.spark, "access-logs")
    SL.write_access_logs(log_lines(t), path, ["log_date", "hour", "dist"])
    return path


@query("src_01_read_access_logs", "select host, status, count(*) as n, false as short from v_hits group by all")
def _(t):
    rows = SL.read_access_logs(t.spark, written_logs(t))
    return rows.groupBy("host", "status", "short").agg(F.count("*").alias("n"))


@query("src_02_discover_files", "select strftime(log_date, '%Y-%m-%d') as log_date, count(*) as files, count(distinct h) as hours, count(distinct user_id % 3) as dists, 1 as folders from (select distinct log_date, hour(ts) as h, user_id % 3 as user_id from v_hits) group by 1")
def _(t):
    h = t("v_hits").select("log_date", F.hour("ts").alias("h"), (F.col("user_id") % 3).cast("string").alias("d")).distinct()
    paths = h.select(F.format_string("/in/E%s.%s-%02d.abc.gz", "d", F.date_format("log_date", "yyyy-MM-dd"), "h").alias("path"))
    again = paths.select(F.replace("path", F.lit("/in/"), F.lit("/late/")).alias("path"))
    return SL.discover(paths.unionByName(again).unionByName(paths.limit(1).select(F.lit("/in/readme.txt").alias("path"))))


@query("src_04_read_upload", "select cast(p_partkey as varchar) as part_key, p_name as name__of_part from part where p_partkey % 10 <> 0")
def _(t):
    path = work_path(t.spark, "upload")
    blank = F.col("p_partkey") % 10 == 0
    t("part").select(F.when(~blank, F.col("p_partkey").cast("string")).alias("Part Key"), F.when(~blank, F.col("p_name")).alias("Name; of Part"), F.lit("x").alias("Unnamed: 2")).write.csv(path, header=True)
    return uploads.read_upload(t.spark, path)


@query("src_05_candidates", "select s_suppkey, ['id' || s_suppkey, 'b1000', 'c' || s_suppkey] as ids, case when s_suppkey % 2 = 0 then 'stated 2, found 3' end as warning from supplier")
def _(t):
    k = F.col("s_suppkey").cast("string")
    wide = t("supplier").select("s_suppkey", F.concat(F.lit("12, 'id"), k, F.lit("'; b1000")).alias("d"), F.concat(F.lit('"c'), k, F.lit('"|b1000 7')).alias("e"), F.when(F.col("s_suppkey") % 2 == 0, "2").otherwise("3").alias("stated"))
    return uploads.candidates(wide, ["d", "e"], "stated").select("s_suppkey", "ids", "warning")


@query("src_06_overwrite_dates", "select data_day, case when data_day > 7 then 'again' else 'first' end as load, count(*) as n from v_shops group by all")
def _(t):
    path = work_path(t.spark, "by-date")
    shops = t("v_shops").select("shop_id", "data_day")
    sinks.overwrite_dates(shops.withColumn("load", F.lit("first")), path, "data_day")
    sinks.overwrite_dates(shops.filter("data_day > 7").withColumn("load", F.lit("again")), path, "data_day")
    return t.spark.read.parquet(path).groupBy("data_day", "load").agg(F.count("*").alias("n"))


def events(t):
    schema = t("events").schema
    if _is_folder(t):
        found = t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/events.parquet")
    else:
        found = ST.event_stream(t.spark, t.sf_dir, "events.parquet", schema)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(t) -> bool:
    """events.parquet may be one file or a folder of parts; Spark's own file names tell."""
    name = t("events").select(F.col("_metadata.file_path")).limit(1).first()
    return bool(name) and not name[0].endswith("/events.parquet")


def settled(t, stream, name):
    """All groups of a stream after it has read everything there is: complete results, replaced batch by batch."""
    path = work_path(t.spark, name)
    ST.run_now(stream, work_path(t.spark, f"{name}-state"), lambda batch, _: batch.write.mode("overwrite").parquet(path), mode="complete")
    return t.spark.read.parquet(path)


_HOURLY = "count(distinct hour(ts))"


def _ingested(t, waves):
    """Log files arrive in the drop folder wave by wave, and each time the stream reads what is new."""
    drop, archive, target, ledger, state = (work_path(t.spark, n) for n in ("drop", "archive", "cube", "ledger", "cube-state"))
    known = stage(t("v_known"), "known")
    for wave in waves:
        SL.write_access_logs(log_lines(t).filter(wave), drop, ["log_date", "hour", "dist"])
        ST.ingest(t.spark, drop, archive, known, t("v_ranges"), target, ledger, state)
    return t.spark.read.parquet(target), t.spark.read.parquet(ledger)


@query("str_01_drop_folder", f"with {_CUBE} select * from cube")
def _(t):
    """Text files of the same dates come in two waves: the cube holds the lines of both."""
    cube, _ = _ingested(t, [F.col("event_id") % 3 == 0, F.col("event_id") % 3 != 0])
    return cube


@query("str_02_completeness", f"""with {_FULL} select log_date, {_HOURLY} as hours_present, cast(count(*) as bigint) as raw_lines, 0 as failed_files, max(bot_lines) as bot_lines, max(known_rows) as known_rows, {_HOURLY} = 24 as is_complete
  from v_hits join (select log_date, count(*) as bot_lines, count(*) filter (is_known_url) as known_rows from full_hits group by 1) using (log_date) group by 1""")
def _(t):
    """The ledger that the ingest keeps."""
    _, ledger = _ingested(t, [F.lit(True)])
    return ledger.select("log_date", "hours_present", "raw_lines", "failed_files", "bot_lines", "known_rows", "is_complete")


@query("str_02_stream_hours", "select cast(ts as date) as log_date, count(distinct hour(ts)) as hours, count(*) as lines, count(distinct hour(ts)) = 24 as complete from events group by 1")
def _(t):
    return ST.complete_dates(settled(t, ST.hours_seen(events(t)), "hours"))


@query("str_03_late_dates", f"with {_CUBE} select log_date, cast(sum(hits) as bigint) as hits, cast(sum(bytes) as bigint) as bytes from cube group by 1")
def _(t):
    """All but the last hour of each date come first; the late hour's files re-ingest their whole dates."""
    cube, _ = _ingested(t, [F.col("hour") < 23, F.col("hour") == 23])
    return cube.groupBy("log_date").agg(F.sum("hits").alias("hits"), F.sum("bytes").alias("bytes"))


@query("str_04_tripwires", "select count(*) as hits, true as passed from v_hits where (host = 'www.shop.example' or host like '%.shop.example') and ua not like '%Firefox%'")
def _(t):
    _, got = ST.gated(L.with_membership(L.parse_hits(t("v_hits")), t("v_known")))
    return t("v_hits").limit(1).select(F.lit(got["hits"]).cast("long").alias("hits"), F.lit(got["known"] > 0).alias("passed"))


@query("str_05_hourly_hits", "select date_trunc('hour', ts) as hour, event_type, count(*) as hits from events group by all")
def _(t):
    return settled(t, ST.hourly_hits(events(t)), "hourly").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("str_06_action_sessions", "with g as (select user_id, ts, case when lag(ts) over w is null or epoch_us(ts) - epoch_us(lag(ts) over w) > 1800000000 then 1 else 0 end as gap from events where event_type in ('signup', 'error') window w as (partition by user_id order by ts, event_id)), s as (select *, sum(gap) over (partition by user_id order by ts rows unbounded preceding) as session from g) select user_id, min(ts) as started_at, count(*) as actions from s group by user_id, session")
def _(t):
    return settled(t, ST.action_sessions(events(t).filter("event_type in ('signup', 'error')")), "sessions").withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))


#: Events come in three waves by time, but for every fiftieth one of the first wave, which comes with the last, too late.
_WAVES = """span as (select epoch_us(min(ts)) as a, epoch_us(max(ts)) as b from events),
  waves as (select e.*, epoch_us(ts) as us, case when epoch_us(ts) < a + 4 * ((b - a) // 10) then case when event_id % 50 = 7 then 2 else 0 end when epoch_us(ts) < a + 7 * ((b - a) // 10) then 1 else 2 end as wave from events e, span)"""


def in_waves(t, name, build):
    """What a stream in append mode has written after three runs on one checkpoint: groups that the watermark has closed, each once."""
    rows = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    a, b = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    edge = lambda k: F.unix_micros("ts") < (a or 0) + k * (((b or 0) - (a or 0)) // 10)
    wave = F.when(edge(4), F.when(F.col("event_id") % 50 == 7, 2).otherwise(0)).when(edge(7), 1).otherwise(2)
    drop, state, path = (work_path(t.spark, f"{name}-{x}") for x in ("drop", "state", "out"))
    late = 0
    for k in range(3):
        rows.filter(wave == k).write.mode("append").parquet(drop)
        late += ST.run_now(build(t.spark.readStream.schema(rows.schema).parquet(drop)), state, path=path)
    return t.spark.read.parquet(path), late


@query("str_05_append", f"with {_WAVES} select date_trunc('hour', ts) as hour, event_type, count(*) as hits from waves where wave < 2 or us >= (select min(us) from waves where wave = 1) group by 1, 2 having epoch_us(date_trunc('hour', ts)) + 10800000000 <= (select max(us) // 1000 * 1000 from waves)")
def _(t):
    """Hours that are closed (two hours of lateness); rows that come later are dropped."""
    return in_waves(t, "hourly", ST.hourly_hits)[0].withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("str_06_append", f"""with {_WAVES}, kept as (select * from waves where wave < 2 or us >= (select min(us) from waves where wave = 1)),
  g as (select user_id, ts, us, case when lag(us) over w is null or us - lag(us) over w > 1800000000 then 1 else 0 end as gap from kept where event_type in ('signup', 'error') window w as (partition by user_id order by ts, event_id)),
  s as (select *, sum(gap) over (partition by user_id order by ts rows unbounded preceding) as session from g)
  select user_id, min(ts) as started_at, count(*) as actions from s group by user_id, session having max(us) + 1800000000 <= (select max(us) // 1000 * 1000 from waves where event_type in ('signup', 'error')) - 3600000000""")
def _(t):
    """Sessions that are closed (an hour of lateness)."""
    actions = lambda s: ST.action_sessions(s.filter("event_type in ('signup', 'error')"))
    return in_waves(t, "sessions", actions)[0].withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))


@query("str_07_fresh_files", "select 'f' || event_id || '.gz' as name, '/a/f' || event_id || '.gz' as path from events where event_id % 3 <> 0")
def _(t):
    name = F.concat(F.lit("/f"), F.col("event_id").cast("string"), F.lit(".gz"))
    files = t("events").select(F.explode(F.array(F.concat(F.lit("/b"), name), F.concat(F.lit("/a"), name))).alias("path"))
    ledger = t("events").filter("event_id % 3 = 0").select(F.concat(F.lit("f"), F.col("event_id").cast("string"), F.lit(".gz")).alias("name"))
    return ST.fresh_files(files, ledger)


@query("str_07_dedupe_stream", "select 'f' || event_id || '.gz' as name from events")
def _(t):
    """Each file comes from two drop folders; the stream keeps one of a name."""
    name = F.concat(F.lit("/f"), F.col("event_id").cast("string"), F.lit(".gz"))
    files = events(t).select("ts", F.explode(F.array(F.concat(F.lit("/b"), name), F.concat(F.lit("/a"), name))).alias("path"))
    path = work_path(t.spark, "fresh")
    ST.run_now(ST.dedupe_files(files), work_path(t.spark, "fresh-state"), path=path)
    return t.spark.read.parquet(path).select("name")


@query("udf_01_sql_functions", "select url, rtrim(split_part(split_part(lower(regexp_replace(url, '^https?://[^/]+', '', 'i')), '?', 1), '#', 1), '/') as p, case when contains(split_part(url, '?', 1), '/c/') then cast(len(string_split(split_part(split_part(url, '?', 1), '/c/', 2), '~~')) as int) else 0 end as depth from (select distinct url from v_visits)")
def _(t):
    register_sql(t.spark)
    return t.spark.sql("select url, npath(url) as p, facet_depth(split_part(url, '?', 1)) as depth from {u}", u=t("v_visits").select("url").distinct())
