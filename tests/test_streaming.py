from lexforge.operators import ledger
from lexforge.streaming import jobs
from pyspark.sql import functions as F


def test_new_documents(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id int, text string, ts timestamp"
    t = "2024-01-01 00:00:0"
    spark.createDataFrame([(1, "a b", t + "1"), (2, "a  b", t + "2"), (3, None, t + "3")], "id int, text string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(src)
    docs = jobs.new_documents(spark.readStream.schema(schema).parquet(src), "text", "ts")
    docs.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination()
    assert spark.read.parquet(out).select("fingerprint").distinct().count() == 2 == spark.read.parquet(out).count()
    assert jobs.new_documents(spark.read.parquet(src), "text", "ts").count() == 2


def test_ledger_goes_on_over_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = ", ".join(f"{f} {'map<string,string>' if f == 'details' else 'string'}" for f in ledger.FIELDS) + ", pos int"
    blank = dict.fromkeys(ledger.FIELDS)
    rows = [blank | {"change_id": f"c{i % 2}", "event_id": f"e{i}", "event_type": "T", "pos": i} for i in range(8)]
    for k in (0, 4):
        spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows[k : k + 4]], schema).coalesce(1).write.mode("append").parquet(src)
        jobs.start_ledger(spark.readStream.schema(schema).parquet(src), "change_id", "pos", out, str(tmp_path / "c")).awaitTermination()
    chain = spark.read.parquet(f"{out}/batch=*")
    assert {(r["valid"], r["n_events"]) for r in ledger.verify(chain, "change_id").collect()} == {(True, 4)}
    whole = ledger.build_chain(spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema), "change_id", "pos")
    assert {(r["event_id"], r["event_hash"]) for r in chain.collect()} == {(r["event_id"], r["event_hash"]) for r in whole.collect()}


def test_latest_rows(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in ([("a", 1, "x"), ("b", 5, "y"), (None, 9, "z")], [("a", 2, "new"), ("b", 4, "late")]):
        spark.createDataFrame(batch, "k string, o int, v string").coalesce(1).write.mode("append").parquet(src)
        jobs.start_latest(spark.readStream.schema("k string, o int, v string").parquet(src), "k", "o", out, str(tmp_path / "c")).awaitTermination()
    assert {tuple(r) for r in jobs.latest(spark, out, "k", "o").collect()} == {("a", 2, "new"), ("b", 5, "y")}


def test_windows(spark):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "k", 1.0), ("2024-01-01 00:50:00", "k", 2.0), ("2024-01-01 01:10:00", "k", None)], "ts string, k string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r["n"], r["total"]) for r in jobs.windowed_counts(rows, "ts", "k").collect()) == [(1, None), (2, 3.0)]


def test_windows_of_a_stream_drop_late_rows_and_replace_open_windows(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = ([("01:10", 1.0), ("01:20", 2.0)], [("01:50", 4.0), ("09:00", 1.0)], [("01:55", 100.0), ("09:30", 2.0)])
    for rows in batches:
        spark.createDataFrame([(f"2024-01-01 {t}:00", "k", v) for t, v in rows], "ts string, k string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(src)
        jobs.start_windows(spark.readStream.schema("ts timestamp, k string, value double").parquet(src), "ts", "k", out, str(tmp_path / "c")).awaitTermination()
    got = {(r["window_start"].hour, r["n"], r["total"]) for r in jobs.windows(spark, out, "k").collect()}
    assert got == {(1, 3, 7.0), (9, 2, 3.0)}
