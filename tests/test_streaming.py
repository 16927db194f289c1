from quire.streaming.live import arriving_pages, in_page_order, latest, live_search


def drain(frame, name, mode="append"):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
        return q
    finally:
        q.stop()


def test_live_search(spark, tmp_path):
    path = f"file://{tmp_path}/pages"
    rows = [(1, p, f"page {p} needle" + " needle" * (p % 2)) for p in range(6)] + [(2, 0, "nothing")]
    spark.createDataFrame(rows, "doc_id long, page_index int, text string").repartition(3).write.parquet(path)
    drain(live_search(arriving_pages(spark, path, files_per_trigger=1), "Needle"), "live")
    assert spark.table("live").count() == 9


def test_pages_wait_for_earlier_ones(spark, tmp_path):
    path = f"file://{tmp_path}/pages"
    for pages in ([3, 2], [0], [1, 1], [5]):
        spark.createDataFrame([(1, p, "x " * (p + 1)) for p in pages], "doc_id long, page_index int, text string").coalesce(1).write.mode("append").parquet(path)
    drain(in_page_order(arriving_pages(spark, path, files_per_trigger=1), "x", most=8), "ordered")
    got = [tuple(r) for r in spark.table("ordered").orderBy("page_index").collect()]
    assert got == [(1, 0, 1, 0), (1, 1, 2, 1), (1, 2, 3, 3), (1, 3, 2, 6)]


def test_latest(spark):
    frame = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "q")], "session string, seq int, view string")
    assert sorted(map(tuple, latest(frame, "session", "seq").collect())) == [("a", 3, "z"), ("b", 1, "q")]
