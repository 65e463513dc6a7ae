from pyspark.sql import functions as F

from quirelake.streaming import events as st


def feed(spark, tmp_path, batches):
    src = tmp_path / "in"
    for i, b in enumerate(batches):
        spark.createDataFrame(b, "u string, s long").withColumn("at", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(str(src))
    return spark.readStream.schema("u string, s long, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(src))


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_sessions(spark, tmp_path):
    s = feed(spark, tmp_path, [[("a", 0), ("a", 600), ("b", 10)], [("a", 9000)], [("z", 90000)], [("z", 90001)]])
    drain(st.sessions(s, "u", "at"), "sess", "append")
    got = {(r["u"], r["start"].timestamp(), r["n"]) for r in spark.table("sess").collect()}
    assert {(u, n) for u, _, n in got} == {("a", 2), ("b", 1), ("a", 1)}


def test_throttled_and_append(spark, tmp_path):
    s = feed(spark, tmp_path, [[("a", 0), ("a", 5)], [("a", 8), ("a", 12)]])
    drain(st.throttled(s, "u", "at", 10_000_000), "thr", "append")
    assert sorted(r["t"] for r in spark.table("thr").collect())[0] == 0
    q = st.append(s, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_daily_bitmaps(spark, tmp_path):
    s = feed(spark, tmp_path, [[("a", 0), ("a", 5), ("b", 7)], [("a", 8)]])
    drain(st.daily_bitmaps(s, "u", "at"), "bits", "complete")
    assert spark.table("bits").agg(F.sum(F.bit_count("bits"))).collect()[0][0] == 2
