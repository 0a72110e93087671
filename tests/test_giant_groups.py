"""Ranks of a category that holds nine tenths of the rows, in pieces, against SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from webinsight.operators import coverage as C
from webinsight.operators import ranks as R


@pytest.fixture(scope="module")
def skewed(spark):
    at = F.col("id")
    hash_ = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    cat = F.when(at % 10 < 9, "giant").when(at % 100 == 99, F.lit(None).cast("string")).otherwise(F.concat(F.lit("c"), (at % 7).cast("string")))
    rows = spark.range(6000).select(F.concat(F.lit("/p/"), at.cast("string")).alias("npath"), cat.alias("deepest_cat"), hash_(40).alias("visits"), F.when(hash_(3) > 0, hash_(900) / 4.0).otherwise(0.0).alias("revenue"), F.when(hash_(11) > 0, hash_(50)).alias("ctr"))
    return rows


@pytest.fixture
def db(skewed):
    con = duckdb.connect()
    con.register("u", skewed.toPandas())
    return con


def same(got, con, sql):
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    none = lambda v: None if v is None or v != v else v
    plain = lambda rows: sorted((tuple(repr(none(v)) for v in r) for r in rows))
    assert sorted(got.columns) == sorted(names)
    assert plain(got.select(*names).collect()) == plain(want.fetchall())


@pytest.fixture(params=[500_000, 300, 0])
def giant(request, monkeypatch, spark):
    """No group is giant; one is; all are."""
    monkeypatch.setattr(R, "GIANT", request.param)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_knees(giant, skewed, db):
    same(C.knees(skewed), db, """with r as (select *, row_number() over w as rn, sum(visits) over (w rows unbounded preceding) as run, sum(visits) over (partition by deepest_cat) as total from u where visits > 0 window w as (partition by deepest_cat order by visits desc, npath))
      select deepest_cat, min(rn) filter (run * 100 >= total * 80) as knee80, min(rn) filter (run * 100 >= total * 90) as knee90, min(rn) filter (run * 100 >= total * 95) as knee95, cast(sum(visits) as bigint) as yearly, count(*) as urls from r group by 1""")


def test_blend_score(giant, skewed, db):
    same(C.blend_score(skewed).select("npath", "score"), db, "select npath, cast(0.889 as double) * percent_rank() over (partition by deepest_cat order by visits) + cast(0.111 as double) * percent_rank() over (partition by deepest_cat order by greatest(revenue, 0)) as score from u")


def test_rank_pct(giant, skewed, db):
    same(C.rank_pct(skewed, "deepest_cat", "ctr").select("npath", "ctr_pct"), db, "select npath, case when ctr is null or isnan(ctr) then 0.5 else (rank() over (partition by deepest_cat, ctr is null or isnan(ctr) order by ctr) + (count(*) over (partition by deepest_cat, ctr) - 1) / 2) / count(*) over (partition by deepest_cat, ctr is null or isnan(ctr)) end as ctr_pct from u")


def test_pieces_are_even(giant, skewed, spark):
    """However large a group is, no partition has more than a few times its share."""
    rows = R.in_order(skewed, ["deepest_cat"], [F.desc("visits"), F.col("npath")])
    sizes = [r["n"] for r in rows.groupBy(R.PART).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 6 or spark.conf.get("spark.sql.adaptive.enabled") == "true"
    placed = R.positions(skewed, ["deepest_cat"], [F.desc("visits"), F.col("npath")], "visits")
    for r in placed.groupBy("deepest_cat").agg(F.sort_array(F.collect_list("pos")).alias("p"), F.max("run").alias("run"), F.max("group_value").alias("g")).collect():
        assert r["p"] == list(range(len(r["p"]))) and r["run"] == r["g"]


def test_selection_is_cut_before_rows_meet(skewed):
    plan = C.select_top(C.blend_score(skewed), default=5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    caps = skewed.sparkSession.createDataFrame([("giant", 7), ("c1", 2)], "deepest_cat string, cap bigint")
    got = {r["deepest_cat"]: r["count"] for r in C.select_top(C.blend_score(skewed), caps=caps, default=4).groupBy("deepest_cat").count().collect()}
    assert got["giant"] == 7 and got["c1"] == 2 and got["c2"] == 4
