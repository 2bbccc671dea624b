from pyspark.sql import functions as F

from gistmill.operators import sessions
from gistmill.streaming import flows

EVENTS = "/root/testdata/sf0.001/events.parquet"


def stream_of(spark, tmp_path):
    rows = spark.read.parquet(EVENTS).select("event_id", "user_id", "ts", "event_type")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    return rows, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))


def drain(query, spark):
    query.processAllAvailable()
    query.stop()
    return spark.table(query.name)


def test_session_stream_equals_batch(spark, tmp_path):
    rows, stream = stream_of(spark, tmp_path)
    name = "session_out"
    q = flows.session_stream(stream, by=("user_id",), delay="1 minute").writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    got = {(r.user_id, r.started, r.n) for r in drain(q, spark).collect()}
    want = {(r.user_id, r.started, r.n) for r in sessions.sessions(rows, by=("user_id",)).collect()}
    last = max(w[1] for w in want)
    # the newest sessions wait for a watermark that no later event brings
    assert got <= want and all((last - w[1]).total_seconds() < 5400 for w in want - got) and len(got) > 500


def test_admitted_stream_equals_batch(spark, tmp_path):
    rows, stream = stream_of(spark, tmp_path)
    q = flows.admitted_stream(stream, per_hour=1).writeStream.format("memory").queryName("admit_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    got = {r.event_id: r.admitted for r in drain(q, spark).collect()}
    assert got == {r.event_id: r.admitted for r in sessions.admitted(rows, per_hour=1).collect()}


def test_incremental_runs_once(spark, tmp_path):
    _, stream = stream_of(spark, tmp_path)
    seen = []
    for _ in range(2):
        flows.incremental(stream, lambda batch, n: seen.append(batch.count()), str(tmp_path / "c")).awaitTermination()
    assert seen == [spark.read.parquet(EVENTS).count()]


def test_expiry(spark):
    rows = spark.createDataFrame([("a", "2026-01-01 00:00:00"), ("b", "2026-01-02 11:00:00"), ("c", "junk")], "id string, created_at string")
    assert {r.id for r in flows.expired(rows, "2026-01-02 12:00:00").collect()} == {"a", "c"}
    counts = flows.hourly_counts(spark.read.parquet(EVENTS))
    assert counts.agg(F.sum("n")).first()[0] == spark.read.parquet(EVENTS).count()
