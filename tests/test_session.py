"""Tables in the shared folder, rows dealt out, the entry points."""

from codelode import session


def test_written_and_spread(spark, tmp_path):
    df = spark.range(100).repartition(1)
    df.write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    got = session.spread(one)
    assert got.selectExpr("spark_partition_id() AS p").distinct().count() > 1 and got.count() == 100
    kept = session.written(got, "test")
    assert kept.schema == got.schema and kept.agg({"id": "sum"}).first()[0] == 4950
    many = spark.range(64).repartition(32)
    many.write.parquet(str(tmp_path / "many"))
    df = spark.read.parquet(str(tmp_path / "many"))
    assert session.spread(df) is df


def test_entry():
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
