from __future__ import annotations

import json

from pyspark.sql import functions as F

from quillspark.sources import records, sinks
from quillspark.streaming import limited


def test_json_records(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "x", "names": {"primary": "X", "common": ["c"]}, "traditional": {"dosing": {"notes": "n"}}, "provenance": {"sources": ["s"]}}, {"id": "y"}]))
    (tmp_path / "b.json").write_text("broken [")
    (tmp_path / "_index.json").write_text('{"total": 2}')
    good, bad = records.json_arrays(spark, str(tmp_path / "*.json"))
    assert [(r.source_file, r.ord, r.id) for r in good.orderBy("ord").collect()] == [("a.json", 0, "x"), ("a.json", 1, "y")]
    assert json.loads(good.where("id = 'x'").first().traditional) == {"dosing": {"notes": "n"}}
    assert {r.source_file for r in bad.collect()} == {"b.json"}  # Spark skips names that begin with an underscore
    (tmp_path / "c.json").write_text('{"id": "z"}')
    assert [r.file for r in records.json_objects(spark, str(tmp_path / "*.json")).collect()] == ["c.json"]


def test_pages_and_scans(spark, tmp_path):
    (tmp_path / "Kava root.htm").write_bytes(b"<p>caf\xe9</p>")
    (tmp_path / "gone.htm").write_bytes(b"")
    got = records.pages(spark, str(tmp_path), glob="*.htm")
    assert [r.html for r in got.collect()] == ["<p>café</p>"]
    assert records.wanted_pages(got.withColumn("url", F.lit("http://x/Kava-Root.htm")), ["kava-root"]).count() == 1
    (tmp_path / "s.txt").write_text("one\ntwo")
    assert records.scans(spark, str(tmp_path / "*.txt")).first().text == "one\ntwo"
    found, failed = records.books([{"id": "a"}, {"id": "b"}], lambda b: spark.range(1) if b["id"] == "a" else 1 / 0)
    assert found.first().source_id == "a" and failed[0][0] == "b"


def test_sinks(spark, tmp_path):
    df = spark.range(10).select(F.col("id").cast("string").alias("id"), F.lit("s").alias("source_id"), F.col("id").alias("idx"))
    assert sinks.write_counted(df, str(tmp_path / "c"), top=F.max("idx")) == {"rows": 10, "top": 9}
    sinks.write_sources(df, str(tmp_path / "s"))
    sinks.write_entities(df, str(tmp_path / "e"), files=2)
    sinks.write_index(df, str(tmp_path / "i"))
    path = sinks.swap_version(df, str(tmp_path / "v"), "1")
    assert all(spark.read.parquet(str(p)).count() == 10 for p in (tmp_path / "s", tmp_path / "e", tmp_path / "i", path))


def test_limiter_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.sql("select id event_id, timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, int(id % 2), 0, 0, id) ts from range(20)").write.parquet(str(src))
    stream = spark.readStream.schema("event_id long, ts timestamp").parquet(str(src))
    q = limited(stream, 4).writeStream.outputMode("append").format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("limited").collect()
    assert len(rows) == 20 and sorted(r.event_id for r in rows if r.allowed) == [0, 1, 2, 3, 4, 5, 6, 7]
