from datetime import datetime, timedelta

from spanwise.streaming.live import rolling_rates, search_stream


def test_search_stream(spark, tmp_path):
    spark.createDataFrame([("q1", "şeker"), ("q2", "mide")], "qid string, question string").write.parquet(str(tmp_path / "in"))
    chunks = spark.createDataFrame([(1, 0, "şeker tatlıdır"), (2, 0, "mide yanar"), (3, 0, "uyku iyidir"), (4, 0, "su içilir")], "doc_id long, chunk_no int, body string")
    got = {}
    stream = spark.readStream.schema("qid string, question string").parquet(str(tmp_path / "in"))
    q = search_stream(stream, chunks, lambda hits, n: got.update({(r["qid"], r["rank"]): r["doc_id"] for r in hits.collect()}), str(tmp_path / "cp"), 1)
    q.processAllAvailable()
    q.stop()
    assert got == {("q1", 1): 1, ("q2", 1): 2}


def test_rolling_rates(spark, tmp_path):
    t = datetime(2025, 1, 1, 10)
    rows = [(1, "m", t, False, False), (1, "m", t, False, False), (2, "m", t + timedelta(minutes=5), True, None), (3, "m", t + timedelta(hours=90), False, True)]
    spark.createDataFrame(rows, "answer_id long, model string, answered_at timestamp, abstained boolean, supported boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = "answer_id long, model string, answered_at timestamp, abstained boolean, supported boolean"
    s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = rolling_rates(s).writeStream.outputMode("append").format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r)[1:] for r in spark.sql("select * from rates").collect()] == [("m", 2, 1, 1)]
