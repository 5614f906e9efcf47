"""What speech models leave, as tables: recognised and aligned segments, and speaker turns, in the engine's shapes.

Models run elsewhere, or as plug-ins that return these rows. raw segments: (doc_id, ord, text, start, end,
speaker, words array<struct<text, start, end, probability, score, speaker>>); fields that a model lacks are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.sequence import renumber
from ..schema import SENTENCE, WORD

RAW_WORD = "struct<text:string,start:double,end:double,probability:double,score:double,speaker:string>"
RAW = f"doc_id string, ord int, text string, start double, end double, speaker string, words array<{RAW_WORD}>"


def named(speaker: Column) -> Column:
    """A speaker's name; blank is none."""
    return F.nullif(strip(speaker), F.lit(""))


def common_of(words: Column) -> Column:
    """The one speaker of an array of words, else null."""
    names = F.array_distinct(F.filter(F.transform(words, lambda w: w["speaker_id"]), lambda x: x.isNotNull()))
    return F.when(F.size(names) == 1, F.get(names, F.lit(0)))


def _words(confidence, fine) -> Column:
    held = F.filter(F.coalesce("words", F.array().cast(f"array<{RAW_WORD}>")), lambda w: F.coalesce(strip(w["text"]) != "", F.lit(False)) & fine(w))
    out = F.transform(held, lambda w: F.struct(strip(w["text"]).alias("text"), w["start"].alias("start"), w["end"].alias("end"), confidence(w).alias("confidence"), named(w["speaker"]).alias("speaker_id")))
    return out.cast(f"array<{WORD}>")


def _segments(raw: DataFrame, words: Column, speaker: Column, key: str) -> DataFrame:
    """One sentence a segment; ranges are widened to their words; blank texts go; positions count what stays."""
    rows = raw.withColumn("text", strip(F.col("text"))).where("text <> ''").withColumn("w", words)
    some = F.size("w") > 0
    start, end = F.coalesce("start", F.lit(0.0)), F.coalesce("end", "start", F.lit(0.0))
    rows = rows.withColumns({"s": F.when(some, F.least(start, F.get("w", F.lit(0))["start"])).otherwise(start), "e": F.when(some, F.greatest(end, F.element_at(F.when(some, F.col("w")), -1)["end"])).otherwise(end), "p": speaker})
    sentence = F.array(F.struct(F.col("text"), F.col("s").alias("start"), F.col("e").alias("end"), F.col("p").alias("speaker_id"), F.col("w").alias("words"))).cast(f"array<{SENTENCE}>")
    out = rows.select(key, "ord", "text", F.col("s").alias("start"), F.col("e").alias("end"), F.col("p").alias("speaker_id"), sentence.alias("sentences"))
    return renumber(out, [key], ["ord"], "position", 0).select(key, F.col("position").cast("int").alias("position"), "text", "start", "end", "speaker_id", "sentences")


def recognised(raw: DataFrame, key: str = "doc_id") -> DataFrame:
    """Segments of a recogniser's rows: blank words go, a word's probability is its confidence."""
    return _segments(raw, _words(lambda w: w["probability"], lambda w: F.lit(True)), named(F.col("speaker")), key)


def aligner_input(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """What an aligner is given."""
    return segments.select(key, "position", "start", "end", "text")


def aligned(raw: DataFrame, segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """Segments of an aligner's rows; a document for which none is left keeps its segments.

    Words without a start or an end go; confidence is the score, else the probability; a segment's speaker is its
    own or its words' common one.
    """
    words = _words(lambda w: F.coalesce(w["score"], w["probability"]), lambda w: w["start"].isNotNull() & w["end"].isNotNull())
    new = _segments(raw, words, F.coalesce(named(F.col("speaker")), common_of(F.col("w"))), key)
    return new.unionByName(segments.select(*new.columns).join(new.select(key).distinct(), key, "left_anti"))


def speaker_turns(raw: DataFrame, key: str = "doc_id") -> DataFrame:
    """Turns(turn_idx, speaker_id, start, end) of a diariser's rows(ord, speaker, start, end); blank speakers go, order stays."""
    rows = raw.withColumn("speaker_id", named(F.col("speaker").cast("string"))).where("speaker_id is not null")
    return renumber(rows, [key], ["ord"], "turn_idx", 0).select(key, F.col("turn_idx").cast("int").alias("turn_idx"), "speaker_id", "start", "end")
