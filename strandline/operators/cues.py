"""Cues: built from sentences, merged in pairs, normalised and validated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions.text import readable, srt_block
from ..schema import good_range
from .sequence import greedy_pairs, ordered, renumber


def build_cues(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """One cue per sentence of nested segments(position, text, start, end, speaker_id, sentences); a segment without any is one."""
    one = F.array(F.struct(F.col("text"), F.col("start"), F.col("end"), F.col("speaker_id")))
    some = F.transform("sentences", lambda s: F.struct(s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end"), F.coalesce(s["speaker_id"], F.col("speaker_id")).alias("speaker_id")))
    rows = segments.select(key, "position", F.posexplode(F.when(F.coalesce(F.size("sentences"), F.lit(0)) > 0, some).otherwise(one)).alias("n", "s"))
    return renumber(rows.select(key, "position", "n", "s.*"), [key], ["position", "n"], "index", 1).drop("position", "n")


def should_merge(w, max_gap=lx.MERGE_GAP, max_chars=lx.MERGE_CHARS, marks=lx.TERMINAL_MARKS, suffixes=lx.FINAL_SUFFIXES) -> Column:
    gap = F.lead("start").over(w) - F.col("end")
    closed = F.lit(False)
    for word in (*marks, *suffixes):
        closed = closed | F.col("text").endswith(word)
    fits = F.length(F.concat(F.col("text"), F.lead("text").over(w))) <= max_chars
    same = F.col("speaker_id").eqNullSafe(F.lead("speaker_id").over(w)) & F.lead("start").over(w).isNotNull()
    return (gap >= 0) & (gap <= max_gap) & fits & ~closed & same


def merge_cues(cues: DataFrame, key: str = "doc_id", order: str = "index", **rule) -> DataFrame:
    """Joins neighbouring cues in pairs, never a joined one again, and renumbers from 1."""
    w = ordered([key], [order])
    p = greedy_pairs(cues, [key], [order], should_merge(w, **rule))
    g = p.groupBy(key, "pair").agg(F.min_by("start", order).alias("start"), F.max_by("end", order).alias("end"), F.min_by("speaker_id", order).alias("_s"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "").alias("text"), F.array_sort(F.collect_list(F.struct(order, "speaker_id"))).alias("_all"))
    g = g.withColumn("speaker_id", F.get("_all", F.lit(0))["speaker_id"]).drop("_all", "_s")
    return renumber(g, [key], ["pair"], "index", 1).drop("pair")


def normalise_cues(cues: DataFrame, **rule) -> DataFrame:
    return cues.withColumn("text", readable(F.col("text"), **rule))


def issues(rows: DataFrame, key: str, number: str, base: int, what: tuple[str, str, str], order: str = "ord") -> DataFrame:
    """Duplicate numbers, gaps in numbering, overlaps of neighbours and times that cannot be, as rows (key, code, location)."""
    dup = rows.groupBy(key, number).count().where("count > 1").select(key, F.lit(what[0]).alias("code"), F.col(number).cast("long").alias("location"))
    whole = rows.groupBy(key).agg(F.count_distinct(number).alias("d"), F.count("*").alias("n"), F.min(number).alias("lo"), F.max(number).alias("hi"))
    gap = whole.where(f"not (d = n and lo = {base} and hi = {base} + n - 1)").select(key, F.lit(what[1]).alias("code"), F.lit(None).cast("long").alias("location"))
    w = Window.partitionBy(key).orderBy(order)
    over = rows.withColumn("_p", F.lag("end").over(w)).where("start < _p").select(key, F.lit(what[2]).alias("code"), F.col(number).cast("long").alias("location"))
    bad = rows.where(~good_range(F.col("start").cast("double"), F.col("end").cast("double"))).select(key, F.lit("invalid_time_range").alias("code"), F.col(number).cast("long").alias("location"))
    return dup.unionByName(gap).unionByName(over).unionByName(bad)


def segment_issues(segments: DataFrame, key: str = "doc_id", order: str = "ord") -> DataFrame:
    return issues(segments, key, "position", 0, ("duplicate_segment_position", "gap_in_segment_positions", "overlapping_segments"), order)


def cue_issues(cues: DataFrame, key: str = "doc_id", order: str = "ord") -> DataFrame:
    return issues(cues, key, "index", 1, ("duplicate_subtitle_index", "gap_in_subtitle_indexes", "overlapping_subtitles"), order)


def srt_documents(cues: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, srt): the cues of each document as one text, times in seconds; null where a cue has no valid time, as no cue may go missing."""
    return cue_report(cues, key).select(key, "srt")


def cue_report(cues: DataFrame, key: str = "doc_id", order: str = "index") -> DataFrame:
    """(key, n_cues, n_issues, srt) with one window and one aggregation: what cue_issues counts and srt_documents writes."""
    w = ordered([key], [order])
    block = F.when(good_range(F.col("start"), F.col("end")), srt_block(F.col("index"), F.col("start"), F.col("end"), F.col("text")))
    rows = cues.select(key, "index", F.coalesce(F.col("start") < F.lag("end").over(w), F.lit(False)).alias("over"), block.alias("block"))
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("index", "block"))).alias("a"), F.count("*").alias("n_cues"), F.sum(F.col("over").cast("long") + F.col("block").isNull().cast("long")).alias("n"))
    numbers, blocks = F.transform("a", lambda x: x["index"].cast("long")), F.transform("a", lambda x: x["block"])
    again = F.size(F.array_distinct(F.filter(F.transform(numbers, lambda x, i: F.when(x == F.get(numbers, i - 1), x)), lambda x: x.isNotNull())))
    gap = (numbers != F.sequence(F.lit(1).cast("long"), F.col("n_cues"))).cast("long")
    whole = F.when(~F.exists(blocks, lambda b: b.isNull()), F.array_join(blocks, ""))
    return g.select(key, "n_cues", (F.col("n") + again + gap).alias("n_issues"), whole.alias("srt"))
