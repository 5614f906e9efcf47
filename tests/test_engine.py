"""Sources, sinks, workflow, streaming and the entry points."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandline.plans import oracles, registry, workflow
from strandline.sources import audio, sinks
from strandline.streaming.segments import pause_segments


def test_audio(spark, tmp_path):
    for n in ("b.WAV", "a.mp3", "notes.txt"):
        (tmp_path / n).write_bytes(b"x")
    (tmp_path / "c.ogg").write_bytes(b"")
    assert [(r.name, r.format, r.status) for r in audio.discover(spark, str(tmp_path)).collect()] == [("a.mp3", "mp3", "ok"), ("b.WAV", "wav", "ok"), ("c.ogg", "ogg", "empty")]
    (tmp_path / "a.wav").write_bytes(b"x")
    with pytest.raises(audio.DuplicateOutput):
        audio.discover(spark, str(tmp_path))
    with pytest.raises(audio.InputNotFound):
        audio.scan_audio(spark, str(tmp_path / "none")).collect()
    with pytest.raises(ValueError):
        audio.normalise_extensions(["mp3"])


def test_end_to_end(spark, tmp_path):
    seg = "struct<text:string,start:double,end:double,speaker_id:string>"
    df = spark.createDataFrame([(1, 0, "lesson", 0.0, 0.5, None, []), (1, 1, "です.", 0.6, 1.1, None, None)], f"doc_id int, position int, text string, start double, end double, speaker_id string, sentences array<{seg}>")
    p = workflow.subtitle_pipeline(strict=True)
    out = p.run(df, check=True)
    srt = registry.cues.srt_documents(out).withColumn("name", F.lit("lesson.srt"))
    sinks.write_files(srt, str(tmp_path), "name", "srt")
    assert (tmp_path / "lesson.srt").read_text() == "1\n00:00:00,000 --> 00:00:01,100\nlessonです。\n\n"
    assert [e["status"] for e in p.events] == ["started", "succeeded"] * 4


def test_console(spark):
    df = spark.createDataFrame([(1, 3, "lesson.mp3", "asr", "succeeded", 1.25, "x.json", None), (1, 3, "lesson.mp3", "asr", "started", None, None, None), (1, 3, "a", "pipeline-total", "failed", None, None, "bad")], "i int, n int, s string, st string, status string, e double, a string, m string")
    lines = [r.x for r in df.select(sinks.console_line(*map(F.col, df.columns)).alias("x")).collect()]
    assert lines == ["[1/3] lesson.mp3 asr done 1.25s -> x.json", "[1/3] lesson.mp3 asr started", "[1/3] a pipeline-total failed 0.00s: bad"]


def test_registry():
    r = workflow.Registry()
    r.add("a", 1)
    with pytest.raises(workflow.ToolError):
        r.add_many({"b": 2, "a": 3})
    assert r.names() == ["a"] and r.resolve("a") == 1 and r.get("b") is None
    p = workflow.Plugins()
    p.add("plug", lambda tools: tools.add("c", 3))
    assert p.activate_all(r) == {"plug": ["c"]}


def test_streaming(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = pause_segments(e).count()
    e.repartition(1).write.parquet(str(tmp_path / "in"))
    q = pause_segments(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), late="1000 days").writeStream.outputMode("complete").format("memory").queryName("segs").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert batch > 0 and spark.table("segs").count() == batch


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(oracles.ORACLE) <= set(registry.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(oracles.ORACLE))
def test_oracle(spark, name):
    import os

    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"create view {f[:-8]} as select * from '{d}/{f}'")
    df = registry.QUERIES[name](spark, d)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*cols).collect())
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({oracles.ORACLE[name]})").fetchall()
    assert got == sorted(map(repr, want))
