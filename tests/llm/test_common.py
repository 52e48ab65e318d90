"""What several operators share."""

from pyspark.sql import functions as F

from tradewind import session
from tradewind.llm.common import configure, join_grouped


def test_grouped_side_has_a_shuffle_of_its_own(spark):
    """Only then can adaptive execution cut the key that a third of the rows hold."""
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        rows = spark.range(300).selectExpr("if(id % 3 = 0, null, id % 50) AS k", "id AS v")
        rows = rows.withColumn("k", F.coalesce("k", F.lit(-1)))
        groups = rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 4")
        plain = rows.join(groups, "k")
        joined = join_grouped(rows, groups, ["k"])
        shuffles = [
            x._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
            for x in (plain, joined)
        ]
        assert shuffles[1] == shuffles[0] + 1
        assert joined.columns == plain.columns
        assert sorted(joined.collect()) == sorted(plain.collect())
        semi = join_grouped(rows, groups, ["k"], "left_semi")
        assert semi.columns == rows.columns and semi.count() == plain.count()
    finally:
        spark.conf.set(setting, before)


def test_operators_join_without_runtime_filters(spark, tmp_path):
    """The marketplace's are sized for its own joins, and come back with its settings."""
    n = F.col("id")
    spark.range(0, 600_000, 1, 4).select(n, F.md5(n.cast("string")).alias("text")).write.parquet(str(tmp_path / "rows"))
    spark.range(600_000).select(n, (n % 3).alias("kind")).write.parquet(str(tmp_path / "some"))
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [spark.conf.get(name) for name in names]
    spark.conf.set(names[0], "-1")
    try:
        found = []
        for configured in (configure, session.configure):
            configured(spark)
            rows, some = (spark.read.parquet(str(tmp_path / t)) for t in ("rows", "some"))
            plan = rows.join(some.where("kind = 1").select("id"), "id")._jdf.queryExecution().optimizedPlan()
            found.append("might_contain" in plan.toString())
        assert found == [False, True]
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)
