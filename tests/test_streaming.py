from pyspark.sql import functions as F

from tessera.operators import blocking
from tessera.plans import queries as Q
from tessera.streaming.stream import event_counts, link_stream

SF = "/root/testdata/sf0.001"


def test_a_stream_of_queries_gets_the_candidates_of_a_table(spark, tmp_path):
    ref, q = Q._reference(spark, SF), Q._queries(spark, SF)
    q.repartition(3).write.parquet(str(tmp_path / "in"))
    index = blocking.build_index(ref)
    stream = spark.readStream.schema(q.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    batches = []

    def sink(rows, n):
        batches.append({(r["q_id"], r["s1_id"], round(r["score"], 6)) for r in rows.collect()})

    link_stream(stream, index, sink, str(tmp_path / "cp"), 5).awaitTermination()
    want = {(r["q_id"], r["s1_id"], round(r["score"], 6)) for r in blocking.generate_candidates(ref, q, 5).collect()}
    assert len(batches) == 3 and set().union(*batches) == want
    # what was answered is not answered again
    link_stream(stream, index, sink, str(tmp_path / "cp"), 5).awaitTermination()
    assert len(batches) == 3


def test_windows_of_a_stream_close_behind_the_watermark(spark, tmp_path):
    rows = [("2024-01-01 10:05:00", "a", 1.0), ("2024-01-01 10:50:00", "a", 2.0), ("2024-01-01 11:30:00", "b", 4.0), ("2024-01-01 13:00:00", "b", 8.0)]
    late = [("2024-01-01 10:10:00", "a", 99.0), ("2024-01-01 14:00:00", "c", 1.0)]
    closed = {}

    def run(k, part):
        spark.createDataFrame(part, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
        keep = lambda out, n: closed.update({(k, str(r["start"]), r["event_type"]): (r["n"], r["total"]) for r in out.collect()})
        event_counts(stream).writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    run(0, rows)
    run(1, late)
    assert closed == {(0, "2024-01-01 10:00:00", "a"): (2, 3.0), (0, "2024-01-01 11:00:00", "b"): (1, 4.0)}
    table = event_counts(spark.read.parquet(str(tmp_path / "in")))
    assert {(str(r["start"]), r["event_type"]): r["n"] for r in table.collect()}["2024-01-01 10:00:00", "a"] == 3
