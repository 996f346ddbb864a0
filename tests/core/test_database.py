"""Reads and appends by JDBC, against the embedded database that comes with Spark."""

from gleanspark.sources import database

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def test_ranges_of_a_key(spark, tmp_path):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    url = "jdbc:derby:memory:gleanspark;create=true"
    rows = spark.createDataFrame([(i, i * 0.5) for i in range(100)] + [(None, -1.0)], "run_id long, score double")
    database.append_rows(rows, url, "runs", DRIVER)
    found = database.read_table(spark, url, "runs", "run_id", 4, DRIVER, quote='"')
    assert found.rdd.getNumPartitions() == 4
    assert sorted(r.score for r in found.collect()) == sorted(r.score for r in rows.collect())
    assert found.where("run_id >= 90").count() == 10
    assert database.read_table(spark, url, "runs", driver=DRIVER).count() == 101
    database.append_rows(rows.limit(0), url, "empty_runs", DRIVER)
    assert database.read_table(spark, url, "empty_runs", "run_id", 4, DRIVER, quote='"').count() == 0
