"""Queries against their SQL on rows that only larger tables have."""

import re

import duckdb
from pyspark.sql import functions as F

from webinsight.functions import text as X
from webinsight.operators import logs as L
from webinsight.plans import load, registry
from webinsight.sources import logs as SL

from .conftest import SF
from .test_oracles import rows

REGISTRY = load()


def same(spark, folder, name, **tables):
    """The query's rows are the SQL's, over tables given as SQL; returns them."""
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for table, sql in tables.items():
        db.execute(f"copy ({sql}) to '{folder}/{table}.parquet' (format parquet)")
        db.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    df = REGISTRY.QUERIES[name](spark, str(folder))
    want = db.execute(REGISTRY.ORACLES[name])
    names = [d[0] for d in want.description]
    want = rows(names, want.fetchall())
    assert rows(df.columns, df.collect()) == want
    return want


def test_dominant_category_where_counts_pass_ten(spark, tmp_path):
    """The largest category stays, though the key of another one with ten rows holds a word of the query."""
    part = "select i as p_partkey, 'large ring' as p_name, case when i < 20 then 'Brand#1' else 'Brand#2' end as p_brand, case when i < 20 then 'PROMO' else 'LARGE' end as p_type from range(32) r(i)"
    assert len(same(spark, tmp_path, "key_08_dominant_category", part=part)) == 1


def test_upsert_where_part_keys_reach_the_suppliers(spark, tmp_path):
    """Parts 1000001 to 1000003 and suppliers 1 and 2 all stay."""
    part = "select k as p_partkey, 'red ring ' || k as p_name from (values (cast(1 as bigint)), (3), (1000001), (1000002), (1000003)) v(k)"
    supplier = "select k as s_suppkey, 'Supplier ' || k as s_name from (values (cast(1 as bigint)), (2)) v(k)"
    assert len(same(spark, tmp_path, "src_07_upsert", part=part, supplier=supplier)) == 7


def test_clean_upload_where_documents_are_bad_themselves(spark, tmp_path):
    """Reasons come from the planted rows alone, whatever the texts are; the operator's own reading of such texts stays."""
    documents = "select cast(k as bigint) as doc_id, x as text from (values (1, ''), (2, '12 34'), (3, null), (4, '<i>7</i>'), (6, chr(1)), (8, 'ab'), (null, 'ab'), (5, ''), (7, '1'), (11, 'a'), (13, '1'), (26, 'a')) v(k, x)"
    assert len(same(spark, tmp_path, "txt_02_clean_upload", documents=documents)) == 5
    text = spark.createDataFrame([(1, " "), (2, "12 <b>34</b>"), (3, None), (4, "a1"), (None, "a")], "id int, text string")
    got = [r["reason"] for r in text.select(X.quarantine_reason(F.col("id"), F.col("text"), F.lit(4), 4).alias("reason")).collect()]
    assert got == ["empty", "numeric_only", "empty", None, "no_id"]


def test_coverage_grade_reads_visits_once(spark, monkeypatch):
    """One pass over the visits, and facets are parsed by URL: what is left to do reads no visits."""
    seen, table = [], registry.table
    monkeypatch.setattr(registry, "table", lambda spark, folder, name: seen.append(name) or table(spark, folder, name))
    graded = REGISTRY.QUERIES["con_18_coverage_grade"](spark, SF)
    assert seen == ["v_visits"]
    assert "lineitem" not in graded._jdf.queryExecution().optimizedPlan().toString() and not any("lineitem" in f for f in graded.inputFiles())


def test_late_dates_parse_lines_once(spark, monkeypatch):
    """Every date is rebuilt from parsed rows: what classifies and verifies hits opens no landed lines."""
    seen, verify = [], L.verify_ips
    monkeypatch.setattr(L, "verify_ips", lambda hits, ranges: seen.append(hits.inputFiles()) or verify(hits, ranges))
    assert REGISTRY.QUERIES["str_03_late_dates"](spark, SF).count() > 0
    assert len(seen) == 2 and all(seen) and not any("-landing" in f for files in seen for f in files)


def test_log_folders_hold_few_files(spark, tmp_path, request):
    """A folder is one file until it has many lines; each file has the header, and no line is lost."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(400).select((F.col("id") % 2).alias("hour"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("line"))
    for path, given, least, top in (("few", {}, 2, 2), ("many", {"most": 60}, 3, 8)):
        SL.write_access_logs(rows, str(tmp_path / path), ["hour"], **given)
        files = [f.read_text().splitlines() for f in (tmp_path / path).rglob("*.txt")]
        assert least <= len(files) <= top
        assert all(f[0] == "#Version: 1.0" and f[1].startswith("#Fields: ") for f in files)
        assert sorted(x for f in files for x in f if not x.startswith("#")) == sorted(f"line {i}" for i in range(400))


def test_dates_of_files_are_those_of_the_whole_path(spark):
    """Sought in the name alone, a date is the one that the pattern finds in the path."""
    paths = ["file:///in/E1.2024-01-02-05.abc.gz", "/in/A.2024-01-02-05.x", "/in/a.2024-01-01-01.x/b", "/.2024-01-02-05.x", "/in/a.b.2024-01-02-05.x.gz", "/in/2024-01-02-05.x", "/in/log_date=2024-01-03/hour=7/part-0.c000.txt", "/in/log_date=2024-01-03/A.2024-01-02-05.x", "A.2024-01-02-05.x", "/in/A.2024-01-02-05.x.y", "/in/", ""]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", SL.file_date(F.col("p")).alias("day"), SL.file_hour(F.col("p")).alias("hour")).collect()
    for r in got:
        name, day, hour = (re.search(x, r["p"]) for x in (SL.FILE_NAME, r"log_date=(\d{4}-\d{2}-\d{2})", r"hour=(\d{1,2})"))
        assert (r["day"], r["hour"]) == (name[2] if name else day and day[1], int(name[3]) if name else hour and int(hour[1])), r["p"]
