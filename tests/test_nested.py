"""Nested segments: boundary passes with words, speakers, conversion of model outputs, constraints."""

import pytest
from pyspark.sql import functions as F

from strandline import schema
from strandline.operators import nested
from strandline.sources import transcripts


def seg(position, *sentences, speaker=None):
    """sentences: lists of (word, start, end) or (text, words)."""
    out = []
    for s in sentences:
        text, words = s if isinstance(s, tuple) else ("".join(w[0] for w in s), s)
        out.append((text, words[0][1], words[-1][2], speaker, [(w, float(a), float(b), None, None) for w, a, b in words]))
    return ("d", position, "".join(s[0] for s in out), out[0][1] * 1.0, out[-1][2] * 1.0, speaker, [(t, float(a), float(b), p, w) for t, a, b, p, w in out])


def resolve(spark, *rows):
    segments, decisions = nested.resolve_boundaries(schema.create(spark, "segments", list(rows)))
    return segments.orderBy("position").collect(), decisions.orderBy("position", "sentence_index", "word_index").collect()


def test_overlap_keeps_words(spark):
    a = seg(0, [("学生は授業を", 104.0, 106.0), ("休んだ", 106.0, 107.94)])
    b = seg(1, [("休", 107.94, 107.94), ("んだ", 107.94, 107.94), ("ときどのように確認しますか", 107.94, 112.0)])
    out, _ = resolve(spark, a, b)
    assert [(r.position, r.text, r.start, r.end) for r in out] == [(0, "学生は授業を休んだときどのように確認しますか", 104.0, 112.0)]
    assert [w.text for w in out[0].sentences[0].words] == ["学生は授業を", "休んだ", "ときどのように確認しますか"]


def test_echo_keeps_other_sentences(spark):
    a = seg(0, [("これは本", 0.0, 1.0), ("です", 1.0, 1.5)])
    b = seg(1, [("です", 1.5, 1.6), ("ね", 1.6, 2.0)], [("次。", 2.0, 3.0)])
    out, _ = resolve(spark, a, b)
    assert [(r.text, r.start) for r in out] == [("これは本です", 0.0), ("ね次。", 1.6)] and [s.text for s in out[1].sentences] == ["ね", "次。"]


def test_continuation_and_comma(spark):
    a = seg(0, [("前。", 100.0, 101.0)], [("学生は授業を休んだ", 104.62, 107.94)], speaker="a")
    b = seg(1, [("とき、", 107.94, 109.0), ("どうして", 109.0, 111.08)], [("後", 112.0, 113.0)], speaker="a")
    c = seg(2, [("話を聞いて", 114.0, 115.0)], speaker="b")
    d = seg(3, [("話を", 116.0, 117.0)], speaker="b")
    out, _ = resolve(spark, a, b, c, d)
    assert [r.text for r in out] == ["前。学生は授業を休んだとき、どうして後", "話を聞いて、", "話を"]
    assert [s.text for s in out[0].sentences] == ["前。", "学生は授業を休んだとき、どうして", "後"] and out[0].sentences[1].words[-1].text == "どうして"
    assert out[1].sentences[0].words[-1].text == "話を聞いて、" and (out[1].start, out[1].end) == (114.0, 115.0)


def test_split_returns_sentences(spark):
    words = [("聞い て", 5.81, 5.92), ("ください", 5.92, 6.16), ("音", 6.81, 7.67), ("をｶﾀ", 7.7, 8.0)]
    out, told = resolve(spark, seg(0, ("聞い てください 音をｶﾀ", words)))
    assert [s.text for s in out[0].sentences] == ["聞い てください", "音をカタ"] and out[0].text == "聞い てください音をカタ"
    assert [(d.word_index, d.reason, round(d.gap_seconds, 2)) for d in told] == [(1, "pause_after_sentence_final", 0.65)]
    assert [w.text for w in out[0].sentences[1].words] == ["音", "をｶﾀ"]
    same = seg(0, ("a b", [("a", 0.0, 1.0), ("b", 1.0, 2.0)]))
    assert resolve(spark, same)[0][0].text == "a b"
    assert resolve(spark)[0] == []


def test_speakers(spark):
    rows = [seg(0, [("そう", 0.0, 0.4), ("はい", 0.6, 1.0)]), ("d", 1, "x", 9.0, 9.5, "own", []), ("e", 5, "y", 0.0, 1.0, None, [])]
    turns = schema.create(spark, "turns", [("d", 0, "S0", 0.0, 0.5), ("d", 1, "S1", 0.5, 1.1), ("d", 2, " ", 8.0, 10.0)])
    out = nested.by_speaker(schema.create(spark, "segments", rows), turns).orderBy("doc_id", "position").collect()
    assert [(r.doc_id, r.position, r.text, r.speaker_id) for r in out] == [("d", 0, "そう", "S0"), ("d", 1, "はい", "S1"), ("d", 2, "x", "own"), ("e", 5, "y", None)]
    assert out[1].sentences[0].words[0].speaker_id == "S1"


def test_model_outputs(spark):
    w = [(" a ", 0.5, 1.0, 0.9, None, "s"), (" ", 1.0, 1.1, None, None, None), ("b", 1.0, 2.5, None, 0.4, "s")]
    raw = spark.createDataFrame([("d", 3, " ", 0.0, 1.0, None, None), ("d", 7, " a b ", 1.0, 2.0, " ", w), ("d", 9, "c", 3.0, 4.0, "t", None)], transcripts.RAW)
    got = transcripts.recognised(raw).orderBy("position").collect()
    assert [(r.position, r.text, r.start, r.end, r.speaker_id) for r in got] == [(0, "a b", 0.5, 2.5, None), (1, "c", 3.0, 4.0, "t")]
    assert [(x.text, x.confidence) for x in got[0].sentences[0].words] == [("a", 0.9), ("b", None)]
    base = transcripts.recognised(raw)
    more = spark.createDataFrame([("d", 0, "z", None, None, None, [("z", None, 1.0, None, 0.5, None), *w])], transcripts.RAW)
    new = transcripts.aligned(more, base).collect()
    assert [(r.text, r.start, r.end, r.speaker_id, len(r.sentences[0].words)) for r in new] == [("z", 0.0, 2.5, "s", 2)] and new[0].sentences[0].words[1].confidence == 0.4
    assert transcripts.aligned(more.limit(0), base).count() == 2
    turns = transcripts.speaker_turns(spark.createDataFrame([("d", 1, " ", 0.0, 1.0), ("d", 4, " A", 1.0, 2.0)], "doc_id string, ord int, speaker string, start double, end double"))
    assert [tuple(r) for r in turns.collect()] == [("d", 0, "A", 1.0, 2.0)]
    assert transcripts.aligner_input(base).columns == ["doc_id", "position", "start", "end", "text"]


def test_constraints(spark, tmp_path):
    nan = float("nan")
    s = ("x", 0.0, 9.0, None, [("w", 8.0, 10.0, 1.5, None)])
    rows = [("d", 0, "ok", 0.0, 1.0, None, []), ("d", -1, "　", 0.0, 1.0, None, []), ("d", 2, "n", 0.0, nan, None, []), ("d", 3, "m", 2.0, 1.0, None, []), ("d", 4, "o", 0.0, 5.0, None, [s])]
    segments = schema.create(spark, "segments", rows)
    got = {(r.code, r.location) for r in schema.model_issues(segments).collect()}
    assert got == {("empty_text", -1), ("invalid_number", -1), ("invalid_time_range", 2), ("invalid_time_range", 3), ("invalid_confidence", 4), ("words_outside_sentence", 4), ("sentences_outside_segment", 4)}
    assert schema.words_of(segments).count() == 1 and schema.sentences_of(segments).count() == 5
    first = segments.where("position = 4").withColumn("sentences", F.transform("sentences", lambda x: x.withField("speaker_id", F.lit("q"))))
    assert first.select(schema.segment_speaker().alias("x")).first().x == "q"
    box = spark.createDataFrame([(0.0, 2.0, 0.0, 2.0), (0.0, 2.0, 1.0, 3.0)], "a double, b double, c double, d double")
    assert [r.x for r in box.select(schema.contains(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("x")).collect()] == [True, False]
    table = schema.DocumentTable(spark, str(tmp_path / "t"))
    for path in ("one", "two"):
        table.save(schema.create(spark, "documents", [("d", path)]))
    assert [r.source_path for r in table.get("d").collect()] == ["two"] and table.get("none").count() == 0
    with pytest.raises(KeyError):
        schema.create(spark, "unknown", [])
