"""Shapes of transcript tables, typed helpers that make them, and the constraints that their rows must meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "struct<text:string,start:double,end:double,confidence:double,speaker_id:string>"
SENTENCE = f"struct<text:string,start:double,end:double,speaker_id:string,words:array<{WORD}>>"
TABLES = {
    "documents": "doc_id string, source_path string",
    "words": "doc_id string, position int, sentence_index int, word_idx int, text string, start double, end double, confidence double, speaker_id string",
    "sentences": f"doc_id string, position int, sentence_index int, text string, start double, end double, speaker_id string, words array<{WORD}>",
    "segments": f"doc_id string, position int, text string, start double, end double, speaker_id string, sentences array<{SENTENCE}>",
    "cues": "doc_id string, index int, text string, start double, end double, speaker_id string",
    "turns": "doc_id string, turn_idx int, speaker_id string, start double, end double",
    "runs": "run_id string, doc_id string, working_directory string",
}


def create(spark: SparkSession, name: str, rows: list) -> DataFrame:
    """A table of one of the shapes from plain rows."""
    return spark.createDataFrame(rows, TABLES[name])


def contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether range b lies in range a, ends included."""
    return (a_start <= b_start) & (b_end <= a_end)


def good_range(start: Column, end: Column) -> Column:
    """Seconds that are there, finite, not negative and in order (a NaN is above all numbers here, so it is asked for)."""
    ok = (start >= 0) & (end >= start) & (end < float("inf")) & ~F.isnan(start) & ~F.isnan(end)
    return F.coalesce(ok, F.lit(False))


def blank(text: Column) -> Column:
    from .functions.text import strip

    return F.coalesce(strip(text) == "", F.lit(True))


def row_issues(rows: DataFrame, number: str, base: int, key: str = "doc_id") -> DataFrame:
    """(key, code, location) of rows(number, text, start, end) that break a constraint; at most one row for each code and row."""
    codes = F.filter(
        F.array(
            F.when(blank(F.col("text")), F.lit("empty_text")),
            F.when(~good_range(F.col("start"), F.col("end")), F.lit("invalid_time_range")),
            F.when(F.coalesce(F.col(number) < base, F.lit(True)), F.lit("invalid_number")),
        ),
        lambda c: c.isNotNull(),
    )
    return rows.select(key, F.explode(codes).alias("code"), F.col(number).cast("long").alias("location"))


def model_issues(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """As row_issues, of nested segments and all that they hold: also confidences out of 0 to 1 and ranges outside of what holds them."""
    none = F.array().cast(f"array<{SENTENCE}>")

    def inner(s):
        words = F.coalesce(s["words"], F.array().cast(f"array<{WORD}>"))
        return F.array(
            F.when(blank(s["text"]) | F.exists(words, lambda w: blank(w["text"])), F.lit("empty_text")),
            F.when(~good_range(s["start"], s["end"]) | F.exists(words, lambda w: ~good_range(w["start"], w["end"])), F.lit("invalid_time_range")),
            F.when(F.exists(words, lambda w: F.coalesce(~w["confidence"].between(0.0, 1.0) | F.isnan(w["confidence"]), F.lit(False))), F.lit("invalid_confidence")),
            F.when(F.exists(words, lambda w: F.coalesce(~contains(s["start"], s["end"], w["start"], w["end"]), F.lit(False))), F.lit("words_outside_sentence")),
            F.when(F.coalesce(~contains(F.col("start"), F.col("end"), s["start"], s["end"]), F.lit(False)), F.lit("sentences_outside_segment")),
        )

    codes = F.array_distinct(F.filter(F.flatten(F.transform(F.coalesce("sentences", none), inner)), lambda c: c.isNotNull()))
    nested = segments.select(key, F.explode(codes).alias("code"), F.col("position").cast("long").alias("location"))
    return row_issues(segments, "position", 0, key).unionByName(nested).distinct()


def sentences_of(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """Flat sentences of nested segments; a segment without any is one sentence without words."""
    rows = segments.select(key, "position", F.posexplode(with_sentences()).alias("sentence_index", "s"))
    return rows.select(key, "position", "sentence_index", "s.*")


def words_of(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """Flat words of all sentences of nested segments."""
    rows = sentences_of(segments, key).select(key, "position", "sentence_index", F.posexplode("words").alias("word_idx", "w"))
    return rows.select(key, "position", "sentence_index", "word_idx", "w.*")


def with_sentences() -> Column:
    """The sentences of a segment's row, or one of its own text, range and speaker."""
    one = F.array(F.struct(F.col("text"), F.col("start"), F.col("end"), F.col("speaker_id"), F.array().cast(f"array<{WORD}>").alias("words"))).cast(f"array<{SENTENCE}>")
    return F.when(F.coalesce(F.size("sentences"), F.lit(0)) > 0, F.col("sentences").cast(f"array<{SENTENCE}>")).otherwise(one)


def segment_speaker() -> Column:
    """A segment's speaker, else the first of its sentences that has one."""
    first = F.get(F.filter(F.transform("sentences", lambda s: s["speaker_id"]), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(F.col("speaker_id"), first)


class DocumentTable:
    """Documents by key in a Parquet folder: saved rows replace those of the same key when they are read."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id") -> None:
        self.spark, self.path, self.key = spark, path, key

    def save(self, documents: DataFrame) -> None:
        documents.withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(self.path)

    def get(self, *keys: object) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        rows = rows.where(F.col(self.key).isin(*keys)) if keys else rows
        last = rows.groupBy(self.key).agg(F.max("saved_at").alias("saved_at"))
        return rows.join(last, [self.key, "saved_at"]).drop("saved_at")
