import pytest
from pyspark.sql import functions as F

from refspark.operators import claims, gates, scores, series
from refspark.plans import views

SF = "/root/testdata/sf0.001"


@pytest.fixture
def large(spark):
    """Tables of this size would be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("view", [views.bracket])
def test_tasks_hold_as_many_rows_of_any_table(spark, large, monkeypatch, view):
    few = view(spark, SF)
    rows = few.count()
    monkeypatch.setattr(views, "TASK_ROWS", rows // 20)
    many = view(spark, SF)
    assert many.rdd.getNumPartitions() >= 20 > few.rdd.getNumPartitions()
    assert many.exceptAll(few).isEmpty() and few.exceptAll(many).isEmpty()


def test_coverage_of_spread_brackets(spark, large, monkeypatch):
    few = series.bracket_coverage(views.bracket(spark, SF), "city")
    monkeypatch.setattr(views, "TASK_ROWS", 300)
    rows = views.bracket(spark, SF)
    assert rows.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0] < 900
    assert sorted(series.bracket_coverage(rows, "city").collect()) == sorted(few.collect())


def test_net_is_the_same_in_parts(spark, large, monkeypatch):
    few = views.net(spark, SF)
    monkeypatch.setattr(views, "TASK_ROWS", 300)
    many = views.net(spark, SF)
    assert many.rdd.getNumPartitions() >= 20 > few.rdd.getNumPartitions()
    assert many.exceptAll(few).isEmpty() and few.exceptAll(many).isEmpty()


@pytest.mark.parametrize("times", [0, 100_000])
def test_no_task_sorts_a_whole_pool(spark, monkeypatch, times):
    monkeypatch.setattr(claims, "TIMES", times)
    net = spark.range(4000).selectExpr("id % 7 series_id", "if(id % 3 = 2, null, id % 3) family", "if(id % 50 = 0, null, date_add(date'2020-01-01', int(id * 37 % 90))) ts", "id seq", "id / 10 net", "9 n")
    pool = claims.pool_series(net, "family", 12)
    w = "over (partition by family order by ts, series_id, seq)"
    want = net.selectExpr("family series_id", "family", "ts", f"row_number() {w} seq", "net", "count(*) over (partition by family) n")
    assert sorted(pool.select(*want.columns).collect(), key=str) == sorted(want.collect(), key=str)
    of = pool.select("family", F.spark_partition_id().alias("part")).distinct().collect()
    assert all(sum(r.family == f for r in of) > 6 for f in (0, 1, None))
    got, plain = ({r[0]: r for r in scores.score_split(x, numbered=k).select("series_id", "n", "n_oos", F.round("per_trade_sharpe", 9), F.round("min_fold_t", 3)).collect()} for x, k in ((pool, True), (want, False)))
    assert got == plain and len(got) == 3


def test_regime_gate_keeps_the_parts_of_its_series(spark, large, monkeypatch):
    of = lambda: gates.regime_gate(views.net(spark, SF), reps=20)
    few = of()
    monkeypatch.setattr(views, "TASK_ROWS", 300)
    many = of()
    assert many.rdd.getNumPartitions() >= 20 > few.rdd.getNumPartitions()
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))
