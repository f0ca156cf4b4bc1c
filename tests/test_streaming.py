import json

from pyspark.sql import functions as F

from proseline.streaming import votes as stream


def test_the_log_is_written_once_a_batch(spark, tmp_path):
    rows = [(1, "a", "b", "email.1", None), (2, "a", "b", "email.1", "rate"), (3, "b", "c", None, None)]
    batch = spark.createDataFrame(rows, "seq long, w string, l string, scenario string, reason string")
    write = stream.append_log(str(tmp_path))
    write(batch, 0)
    write(batch, 0)  # as after a failure
    write(batch.where("seq = 3"), 1)
    read = lambda name: spark.read.parquet(str(tmp_path / name))
    assert sorted(r.seq for r in read("log").collect()) == [1, 3, 3]
    assert {r.outcome: r.n for r in read("tally").groupBy("outcome").agg(F.sum("n").alias("n")).collect()} == {"counted": 3, "rate": 1}
    assert {r.model: r.n for r in read("games").groupBy("model").agg(F.sum("games").alias("n")).collect()} == {"a": 1, "b": 3, "c": 2}
    assert {r.scenario: r.votes for r in read("scenarios").collect()} == {"email.1": 1}


def test_hours_are_counted_as_they_come(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [json.dumps({"t": t}) for t in (0, 3_599_999, 3_600_000, 20_000_000)]
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    source = spark.readStream.schema("t bigint").json(str(tmp_path / "in"))
    run = stream.hourly(source).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted((r.start.hour, r.votes) for r in spark.table("hours").collect()) == [(0, 2), (1, 1), (5, 1)]
