"""The whole chain, its sinks and command line; homophone resolution."""

import json

import pytest
from pyspark.sql import functions as F

from strandline import __main__ as command
from strandline import schema
from strandline.operators import homophone, repair
from strandline.plans import chain
from strandline.plans.workflow import StageFailed
from strandline.sources import sinks, transcripts

KEY = "doc_id string, position int, sentence_index int, start int"
NOUN = ["名詞", "普通名詞"]


def raw(spark):
    w = [("今日は", 0.0, 0.5, 0.9, None, None), ("懲戒", 0.5, 1.0, 0.4, None, None), ("です", 1.0, 1.4, 0.8, None, None), ("天気", 2.0, 2.5, None, None, None)]
    rows = [("a", 0, "今日は懲戒です天気", 0.0, 2.5, None, w), ("bad", 0, "x", -0.5, 1.0, None, None), ("bad", 1, "y", 1.0, 2.0, None, None)]
    return spark.createDataFrame(rows, transcripts.RAW)


def homophones(spark):
    lexicon = spark.createDataFrame([(0, "懲戒", "ちょうかい", NOUN, 0.5), (1, "聴解", "ちょうかい", NOUN, 0.6), (2, "町会", "ちょうかい", ["動詞"], 0.1), (3, "ちょうかい", "ちょうかい", NOUN, 0.1), (4, "天気", "てんき", NOUN, 0.1)], "ord int, surface string, reading string, pos array<string>, vocab_rank double")
    morphemes = spark.createDataFrame([("a", 0, 0, 3, 5, "懲戒", "ちょうかい", NOUN), ("a", 0, 0, 7, 9, "天気", "てんき", NOUN)], "doc_id string, position int, sentence_index int, start int, end int, surface string, reading string, pos array<string>")
    scores = spark.createDataFrame([("a", 0, 0, 3, "懲戒", 0.1), ("a", 0, 0, 3, "聴解", 0.8), ("a", 0, 0, 3, "町会", 0.9), ("a", 0, 0, 3, "ちょうかい", 0.95)], KEY + ", text string, score double")
    return {"morphemes": morphemes, "lexicon": lexicon, "scores": scores}


def test_homophones(spark):
    segments = transcripts.recognised(raw(spark))
    flat = schema.sentences_of(segments)
    given = homophones(spark)
    for pre in (True, False):
        out, told = homophone.resolve(flat, prefilter_targets=pre, **given)
        got = {r.start: r for r in told.collect()}
        assert got[3].reason == "accepted_same_reading_context" and got[3].selected_text == "聴解" and [c.text for c in got[3].candidates] == ["聴解"]
        assert (7 in got) is (not pre)  # a target without lexical candidates is not looked at
    row = out.where("doc_id = 'a'").first()
    assert row.text == "今日は聴解です天気" and [w.text for w in row.words] == ["今日は", "聴解", "です", "天気"] and row.words[1].confidence == 0.4
    model = spark.createDataFrame([("a", 0, 0, 3, "聴解", 0.05)], KEY + ", text string, score double").withColumn("ord", F.lit(0))
    assert homophone.resolve(flat, model=model, **given)[1].where("start = 3").first().reason == "candidate_not_better_than_original"
    t = homophone.surface_confidence(spark.createDataFrame([("a", "懲戒です"), ("a", "戒で")], "doc_id string, text string"), flat.select("doc_id", F.posexplode("words").alias("word_idx", "w")).select("doc_id", "word_idx", "w.text", "w.confidence").where("doc_id = 'a'"), ["doc_id"])
    assert {r.text: r.asr_confidence for r in t.collect()} == {"懲戒です": 0.4, "戒で": None}


def test_word_changes(spark):
    df = spark.createDataFrame([([("懲", 0.0, 1.0, 0.5, "s"), ("戒", 1.0, 2.0, 0.3, "t"), ("懲戒", 2.0, 3.0, None, None), ("懲戒", 3.0, 4.0, None, None)], [("懲戒", "聴解"), ("懲戒", "聴解")])], f"words array<{schema.WORD}>, changes array<struct<original:string,selected:string>>")
    got = df.select(homophone.changed_words("words", "changes").alias("w")).first().w
    assert [(w.text, w.start, w.end, w.confidence, w.speaker_id) for w in got] == [("聴解", 0.0, 2.0, 0.3, "s"), ("懲戒", 2.0, 3.0, None, None), ("懲戒", 3.0, 4.0, None, None)]
    v = spark.createDataFrame([([0.25, 1.0], [100, 300])], "p array<double>, ids array<int>")
    r = v.select(homophone.geometric_mean(F.col("p")).alias("g"), homophone.vocabulary_rank(F.col("ids"), 400).alias("v")).first()
    assert abs(r.g - 0.5) < 1e-12 and r.v == 0.5
    tokens = spark.createDataFrame([(0, "##聴"), (1, "聴"), (2, "[MASK]"), (3, "abc")], "ord int, token string")
    assert [(r.surface, r.ord) for r in homophone.clean_vocabulary(tokens).collect()] == [("聴", 0)]


def test_chain(spark, tmp_path):
    seen = []
    documents = schema.create(spark, "documents", [("a", "in/lesson.mp3"), ("bad", "in/bad.mp3"), ("gone", "in/gone.mp3")])
    turns = schema.create(spark, "turns", [("a", 0, "S0", 0.0, 2.6)])
    options = chain.Options(turns=turns, repairer=F.col("text"), homophones=homophones(spark))
    done = chain.run({"raw": raw(spark), "documents": documents}, options, seen.append, str(tmp_path / "work"))
    assert {(r.doc_id, r.code) for r in done["rejected"].collect()} >= {("bad", "invalid_time_range"), ("gone", "missing_segments")}
    assert [e["stage"] for e in seen if e["status"] == "succeeded"] == [n for n, _, _ in chain.stages(options)] and len(seen) == 18
    out = chain.outputs(done, documents)
    sinks.write_all(out, str(tmp_path / "out"), {".json": "json", ".srt": "srt"})
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["lesson.json", "lesson.srt"]
    doc = json.loads((tmp_path / "out/lesson.json").read_text())
    assert list(doc) == ["schema_version", "source_path", "output_path", "run_id", "segments", "subtitles"] and doc["run_id"] == "transcribe-lesson" and doc["source_path"] == "in/lesson.mp3"
    word = doc["segments"][0]["sentences"][0]["words"][1]
    assert word == {"text": "聴解", "speaker_id": "S0", "confidence": 0.4, "start_seconds": 0.5, "end_seconds": 1.0, "duration_seconds": 0.5}
    assert [s["text"] for s in doc["segments"][0]["sentences"]] == ["今日は聴解です", "天気"] and [c["index"] for c in doc["subtitles"]] == [1, 2]
    assert done["boundary_decisions"].count() == 1 and done["repair_decisions"].where("accepted").count() >= 1
    with pytest.raises(StageFailed):
        chain.run({"raw": raw(spark)}, chain.Options(strict=True))
    with pytest.raises(StageFailed):
        chain.run({"raw": raw(spark), "documents": documents}, chain.Options(strict=True))
    with pytest.raises(StageFailed):
        chain.run({}, chain.Options())
    with pytest.raises(StageFailed):
        chain.plug_in("no_such_module:f")


def test_command_line(spark, tmp_path, capsys):
    raw(spark).write.parquet(str(tmp_path / "raw"))
    assert command.main(["status"]) == 0 and command.main([]) == 2
    assert command.main(["transcribe", str(tmp_path / "raw"), "--output-dir", str(tmp_path / "o"), "--export-srt"]) == 1
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == ["a.json", "a.srt"] and "left out: bad: invalid_time_range" in capsys.readouterr().err
    assert command.main(["transcribe", str(tmp_path / "raw"), "--strict"]) == 1
    assert command.main(["transcribe", str(tmp_path / "raw"), "--lexicon", "x"]) == 1


def test_repair_and_artifacts(spark, tmp_path):
    df = spark.createDataFrame([("d", 0, "今日は日本語"), ("d", 1, "次")], "doc_id string, position int, text string")
    r = repair.repair_with(df, F.concat(F.lit("CURRENT: "), "text", F.lit("。")), "doc_id", "position").orderBy("position").collect()
    assert [x.selected_text for x in r] == ["今日は日本語。", "次。"]
    filled = repair.neighbours(df, ["doc_id"], ["position"], "text").select(repair.prompt("{prev}|{text}|{next}").alias("p"), "position").orderBy("position").collect()
    assert [x.p for x in filled] == ["|今日は日本語|次", "今日は日本語|次|"]
    events = spark.createDataFrame([("in/le ss.mp3", "o", 1, 1, "whisper", "started", None, "", 1), ("in/le ss.mp3", "o", 1, 1, "whisper", "succeeded", 0.5, "", 2), ("in/le ss.mp3", "o", 1, 1, "my-stage", "failed", 0.5, "bad", 3)], "source string, output string, file_index int, file_total int, stage string, status string, elapsed double, message string, recorded_at int")
    sinks.write_files(sinks.artifact_files(events, "run1"), str(tmp_path), "name", "json")
    got = {str(p.relative_to(tmp_path)): json.loads(p.read_text()) for p in tmp_path.rglob("*.json")}
    assert set(got) == {"run1/le_ss/01_whisper.json", "run1/le_ss/my_stage.json", "run1/le_ss/manifest.json"}
    assert got["run1/le_ss/01_whisper.json"]["status"] == "succeeded" and got["run1/le_ss/manifest.json"]["current_stage"] == "my-stage"
    assert sinks.stage_file("subtitle-writer") == "10_write.json"
    with pytest.raises(ValueError):
        sinks.stage_file("._")
    b = spark.createDataFrame([(bytearray(b"abc"), "x")], "content binary, a string")
    assert json.loads(b.select(sinks.json_value(b, ("content",)).alias("j")).first().j) == {"a": "x", "content": {"type": "bytes", "size_bytes": 3}}
