from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestream.operators import answering as A
from lodestream.plans import pipeline
from lodestream.session import fresh_dir
from lodestream.streaming import rates


def test_second_run_indexes_nothing(spark, sf):
    docs = pipeline.sources(spark, sf)
    one = pipeline.ingest(spark, docs, fresh_dir(spark, "run"))
    counted = {r.source_type: r for r in one.counters.collect()}
    assert set(counted) == {"azure-update", "tech-community", "blog-post", "video-transcript"} and all(r.n_indexed > 0 for r in counted.values())
    assert one.index.count() == one.index.select("chunk_id").distinct().count()
    two = pipeline.ingest(spark, docs, fresh_dir(spark, "run"), one.index)
    assert {r.n_indexed for r in two.counters.collect()} == {0} and two.index.count() == one.index.count()
    changed = docs.withColumn("content", F.when(F.col("source_type") == "azure-update", F.concat("content", F.lit(" new"))).otherwise(F.col("content")))
    three = {r.source_type: r.n_indexed for r in pipeline.ingest(spark, changed, fresh_dir(spark, "run"), one.index).counters.collect()}
    assert three["azure-update"] > 0 and three["tech-community"] == 0


def test_empty_run(spark, sf):
    assert pipeline.ingest(spark, pipeline.sources(spark, sf).limit(0), fresh_dir(spark, "run")).counters.count() == 0


def test_answers(spark):
    good = '{"summary": "s", "iq_opportunities": [{"layer": "l", "title": "t", "priority": "urgent"}]}'
    rows = [(1, good), (2, f"Here:\n```json\n{good}\n```"), (3, "just text"), (4, None), (5, "{broken"), (6, '{"recommended_approach": "r"}')]
    got = {r.id: r for r in A.research_answer(spark.createDataFrame(rows, "id int, t string"), "t").collect()}
    assert got[1].summary == got[2].summary == "s" and got[1].opportunities[0].priority == "medium" and got[1].opportunities[0].services == []
    assert got[3].summary == "just text" and got[3].opportunities == [] and got[4].summary == "" and got[5].summary == "{broken"
    assert (got[6].summary, got[6].recommended_approach) == ("", "r")
    quiz = spark.createDataFrame([('x {"questions": [{"question": "q", "options": ["a"], "answer": "a"}]} y',), ("none",), (None,)], "t string")
    assert [len(r[0]) for r in quiz.select(A.quiz(F.col("t"))).collect()] == [1, 0, 0]
    assert [r[0][:8] for r in quiz.select(A.outcome(F.col("t"))).collect()] == ['{"error"'] * 3
    req = spark.createDataFrame([("what is it", 5), ("  ", 5), ("ab", 5), ("what", 100), (None, 5)], "q string, k int")
    assert [r[0] for r in req.select(A.valid_request(F.col("q"), F.col("k"))).collect()] == [True, False, False, False, False]
    lay = spark.createDataFrame([("About Work-IQ",), ("nothing",)], "t string")
    assert [len(r[0]) for r in lay.select(A.mentioned_layers(F.col("t"), ["work-iq", "data-iq"])).collect()] == [1, 2]


def test_rate_limit_as_a_stream(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("u", t0 + timedelta(seconds=s)) for s in (0, 10, 20, 61, 65, 200)]
    src = f"{tmp_path}/in"
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, "k string, ts timestamp").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 10).parquet(src)
    q = rates.rate_limited_stream(stream, "k", "ts", 2).writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [r.allowed for r in spark.table("limited").orderBy("ts").collect()]
    batch = rates.rate_limited(spark.createDataFrame(rows, "k string, ts timestamp").withColumn("i", F.lit(0)), ["k"], "ts", "i", 2)
    assert got == [r.allowed for r in batch.orderBy("ts").collect()] == [True, True, False, True, False, True]
