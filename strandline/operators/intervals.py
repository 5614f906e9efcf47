"""Interval joins within a document, and the speaker of each word by time overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import runs


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def interval_join(left: DataFrame, right: DataFrame, key: str, bucket: float | None = None) -> DataFrame:
    """Pairs of left(start, end) and right(t_start, t_end) of a key that overlap by more than nothing.

    With ``bucket``, both sides are dealt to time buckets and a pair is kept in its first common one:
    the work of a long document is spread, and the join stays an equality.
    """
    hit = (F.col("start") < F.col("t_end")) & (F.col("t_start") < F.col("end")) & (F.least("end", "t_end") > F.greatest("start", "t_start"))
    if bucket is None:
        return left.join(right, key).where(hit)
    a = left.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))))
    b = right.withColumn("_b", F.explode(F.sequence(F.floor(F.col("t_start") / bucket), F.floor(F.col("t_end") / bucket))))
    return a.join(b, [key, "_b"]).where(hit & (F.col("_b") == F.floor(F.greatest("start", "t_start") / bucket))).drop("_b")


def assign_speakers(words: DataFrame, turns: DataFrame, key: str, word: list[str], bucket: float | None = None) -> DataFrame:
    """words with ``assigned``: the speaker of the greatest summed overlap (ties: whose first overlapping turn comes first), else its own."""
    t = turns.select(key, "turn_idx", F.col("speaker_id").alias("t_speaker"), F.col("start").alias("t_start"), F.col("end").alias("t_end")).where("trim(t_speaker) <> ''")
    met = interval_join(words.select(key, *word, "start", "end"), t, key, bucket)
    sums = met.groupBy(key, *word, "t_speaker").agg(F.sum(F.least("end", "t_end") - F.greatest("start", "t_start")).alias("o"), F.min("turn_idx").alias("f"))
    best = sums.groupBy(key, *word).agg(F.max_by("t_speaker", F.struct("o", -F.col("f"))).alias("best"))
    return words.join(best, [key, *word], "left").withColumn("assigned", F.coalesce("best", "speaker_id")).drop("best")


def speaker_runs(words: DataFrame, sentence: list[str], order: str = "word_idx") -> DataFrame:
    """One row per run of words of one speaker: text (the whole sentence's if it is one run), range, speaker."""
    r = runs(words, sentence, [order], "assigned")
    whole = F.max("run").over(Window.partitionBy(*sentence)) == 0
    r = r.withColumn("_w", whole)
    g = r.groupBy(*sentence, "run").agg(F.min_by("start", order).alias("start"), F.max_by("end", order).alias("end"), F.first("assigned").alias("speaker_id"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "").alias("words_text"), F.min_by("sentence_text", order).alias("sentence_text"), F.first("_w").alias("_w"))
    return g.withColumn("text", F.when(F.col("_w"), F.col("sentence_text")).otherwise(F.col("words_text"))).drop("_w", "words_text", "sentence_text")


def common_speaker(x: Column) -> Column:
    """In an aggregate: the one distinct speaker, else null."""
    return F.when(F.min(x) == F.max(x), F.max(x))
