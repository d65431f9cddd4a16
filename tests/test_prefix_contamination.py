from sievewright.plans import catalogue


def test_short_and_null_items(spark, tmp_path):
    long = "one two three four five six seven"
    spark.createDataFrame([(1, "say two words now"), (2, "x " + long), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "two words"), (2, long), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, catalogue.QUERIES["prefix_contamination"](spark, str(tmp_path)).collect()))
    assert got == [(1, 1), (2, 2)]
