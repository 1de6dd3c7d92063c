import __spark_entry__
from pagelens.streaming.pages import audit_stream, page_stream


def test_stream(spark, tmp_path):
    page = "<html><body><main><h1>Title of it</h1><p>Some text in a page that is long enough.</p><p>More of it.</p></main></body></html>"
    spark.createDataFrame([(1, "http://a.b/", page)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/in/a")
    spark.createDataFrame([(2, "http://a.b/2", page)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/in/b")
    audit_stream(page_stream(spark, f"{tmp_path}/in/*", 1), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.page_id for r in rows) == [1, 2]
    audit_stream(page_stream(spark, f"{tmp_path}/in/*", 1), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
