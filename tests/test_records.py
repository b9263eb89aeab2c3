"""Registered record queries on odd tables."""

import duckdb

from apportion import registry


def documents(spark, tmp_path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))


def test_gc_histogram_counts_empty_texts(spark, tmp_path):
    documents(spark, tmp_path, ["GC", "", "aCgT", None, "", "at"])
    got = {x.gc: x.n for x in registry.QUERIES["gc_histogram"](spark, str(tmp_path)).collect()}
    assert got == {100: 1, 50: 1, 0: 1, None: 3}


def test_checksum_is_that_of_the_sql(spark, tmp_path):
    documents(spark, tmp_path, ["", None, "a", "é\r\n\U0001f469‍\U0001f469", "\x00b", " "])
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(registry.ORACLE_SQL["checksum_sum"]).fetchall()
    got = [tuple(x) for x in registry.QUERIES["checksum_sum"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and (0, 0, -1) in got
