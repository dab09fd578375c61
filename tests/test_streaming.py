import os

from pyspark.sql import functions as F

from pyspark.sql.types import _parse_datatype_string

from hotsets.streaming.weekly import read_access_stream, weekly_access_stream
from tests.test_accesslog import RAW, catalog, raw_rows


def test_stream_matches_batch_for_one_year(spark, tmp_out):
    src = os.path.join(tmp_out, "in")
    raw = spark.createDataFrame(raw_rows(), RAW)
    # write the access rows as JSON lines in two files (two daily folders)
    # well-formed rows as JSON lines in two daily folders; the fixture's
    # corrupt row becomes a really malformed line in a third folder
    ok = raw.filter("_corrupt_record IS NULL")
    ok.filter("end_time < 1438387215").coalesce(1).write.json(os.path.join(src, "d1"))
    ok.filter("end_time >= 1438387215").coalesce(1).write.json(os.path.join(src, "d2"))
    os.makedirs(os.path.join(src, "d3"))
    with open(os.path.join(src, "d3", "bad.json"), "w") as f:
        f.write('{"client_domain": "c1", "end_time": 1438387205, "file_lfn": "f1", \n')
    # the fixture's own field types (bytes as double), with the corrupt column
    schema = _parse_datatype_string(RAW)
    stream = read_access_stream(spark, os.path.join(src, "*"), schema, fmt="json")
    weekly = weekly_access_stream(stream, catalog(spark).withColumn("file_lfn", F.col("file_lfn")))
    q = (weekly.writeStream.outputMode("complete").format("memory").queryName("weekly_test")
         .option("checkpointLocation", os.path.join(tmp_out, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.table("weekly_test")
    from hotsets.operators.accesslog import clean_accesses
    from hotsets.operators.weekly import access_popularity
    batch = access_popularity(clean_accesses(raw), catalog(spark))
    cols = ["week", "dataset_name", "client_domain", "numaccesses", "dataset_size", "readbytes"]
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == \
        sorted(tuple(r[c] for c in cols) for r in batch.collect())


def test_append_sink_emits_finished_weeks(spark, tmp_out):
    from hotsets.streaming.weekly import start
    src = os.path.join(tmp_out, "in2")
    day = 1438387200  # 2015-08-01 (week 31)
    late = day + 60 * 86400  # two months later: week 31 is final by then
    rows = [(None, "c1", "h1", day + 10, "f1", 100.0, "s1", "x", "S1", "u", day),
            (None, "c1", "h2", late + 10, "f1", 5.0, "s1", "x", "S1", "u", late)]
    raw = spark.createDataFrame(rows, RAW)
    raw.filter(f"end_time < {late}").coalesce(1).write.json(os.path.join(src, "d1"))
    raw.filter(f"end_time >= {late}").coalesce(1).write.json(os.path.join(src, "d2"))
    stream = read_access_stream(spark, os.path.join(src, "*"), _parse_datatype_string(RAW), fmt="json",
                                max_files_per_trigger=1)
    sink = os.path.join(tmp_out, "weekly_out")
    q = start(weekly_access_stream(stream, catalog(spark)), sink, os.path.join(tmp_out, "ckpt2"),
              available_now=True, rocksdb_state=True)
    q.awaitTermination()
    out = spark.read.parquet(sink)
    got = [(r["week"], r["dataset_name"], r["readbytes"]) for r in out.collect()]
    assert (31, "/A/e-v1/T", 100.0) in got


def test_stream_reads_csv_layout(spark, tmp_out):
    src = os.path.join(tmp_out, "csv_in")
    raw = spark.createDataFrame(raw_rows(), RAW).filter("_corrupt_record IS NULL")
    raw.write.csv(os.path.join(src, "d1"))
    stream = read_access_stream(spark, os.path.join(src, "*"), _parse_datatype_string(RAW), fmt="csv")
    q = (weekly_access_stream(stream, catalog(spark)).writeStream.outputMode("complete").format("memory")
         .queryName("weekly_csv_test").option("checkpointLocation", os.path.join(tmp_out, "ckpt3"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r["week"], r["dataset_name"]): r["readbytes"] for r in spark.table("weekly_csv_test").collect()}
    assert got[(31, "/A/e-v1/T")] == 150.0
