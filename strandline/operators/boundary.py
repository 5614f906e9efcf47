"""Sentence-boundary resolution: stateless passes as windows, stateful ones as folds over one document's array."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicons as lx
from ..functions.text import boundary_overlap, compact, ends_with_any, starts_with_any
from .sequence import islands, ordered

TAIL = "struct<text:string,start:double,end:double,speaker_id:string>"
MARK, STRONG, PAUSE = 1, 2, 4
REASONS = ("terminal_mark", "strong_pause", "repeated_heading", "pause_after_sentence_final", "sentence_final_expression")


def merge_overlaps(segments: DataFrame, key: str = "doc_id", order: str = "position", marks=(*lx.TERMINAL_MARKS, "?", "!")) -> DataFrame:
    """Joins a segment whose text begins with the end (two characters or more) of the text so far, without the echo.

    The joined text takes part in the next comparison, so this is a fold over each document's segments.
    A right segment whose first word is the whole overlap stays apart, as it is an echo. Columns: text,
    start, end, speaker_id, first_word (null: none).
    """
    rows = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.col("text"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.col("speaker_id"), F.col("first_word")))).alias("a"))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        n = F.when(F.size(acc) == 0, F.lit(0)).otherwise(boundary_overlap(last["text"], x["text"]))
        apart = (F.size(acc) == 0) | (n < 2) | F.coalesce(n == F.length(compact(x["first_word"])), F.lit(False)) | ends_with_any(last["text"], marks)
        new = F.struct(x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end"), x["speaker_id"].alias("speaker_id"))
        joined = F.struct(F.concat(last["text"], F.substring(x["text"], n + 1, F.length(x["text"]))).alias("text"), last["start"].alias("start"), x["end"].alias("end"), F.coalesce(last["speaker_id"], x["speaker_id"]).alias("speaker_id"))
        return F.when(apart, F.concat(acc, F.array(new))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined)))

    # the empty array needs a guard: element_at of no element raises
    def safe(acc: Column, x: Column) -> Column:
        first = F.array(F.struct(x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end"), x["speaker_id"].alias("speaker_id")))
        return F.when(F.size(acc) == 0, first).otherwise(step(acc, x))

    out = rows.select(key, F.posexplode(F.aggregate("a", F.array().cast(f"array<{TAIL}>"), safe)).alias("position", "s"))
    return out.select(key, "position", "s.*")


def remove_echoes(segments: DataFrame, key: str = "doc_id", order: str = "position") -> DataFrame:
    """Drops a first word that the segment before already ends with; words(text, start, end) are an array."""
    w = ordered([key], [order])
    before = compact(F.lag("text").over(w))
    echo = compact(F.get("words", F.lit(0))["text"])
    hit = before.isNotNull() & (F.size("words") > 1) & (echo != "") & F.endswith(before, echo) & F.startswith(compact(F.col("text")), echo)
    rest = F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(1)))
    out = segments.withColumn("_h", F.coalesce(hit, F.lit(False)))
    return out.withColumns({"words": F.when(F.col("_h"), rest).otherwise(F.col("words")), "text": F.when(F.col("_h"), F.array_join(F.transform(rest, lambda x: x["text"]), "")).otherwise(F.col("text")), "start": F.when(F.col("_h"), F.get("words", F.lit(1))["start"]).otherwise(F.col("start")), "echo_removed": F.col("_h")}).drop("_h")


def join_continuations(segments: DataFrame, key: str = "doc_id", order: str = "position", max_gap=lx.CONTINUATION_GAP, marks=(*lx.TERMINAL_MARKS, "?", "!"), prefixes=lx.CONTINUATION_PREFIXES) -> DataFrame:
    """Joins segments that open with a dependent word right after an unfinished one of the same speaker."""
    w = ordered([key], [order])
    gap = F.col("start") - F.lag("end").over(w)
    tie = (gap >= 0) & (gap <= max_gap) & ~ends_with_any(F.lag("text").over(w), marks) & starts_with_any(F.col("text"), prefixes) & F.col("speaker_id").eqNullSafe(F.lag("speaker_id").over(w))
    g = islands(segments, [key], [order], tie)
    out = g.groupBy(key, "island").agg(F.min_by("start", order).alias("start"), F.max_by("end", order).alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "").alias("text"), F.get(F.filter(F.transform(F.array_sort(F.collect_list(F.struct(order, "speaker_id"))), lambda x: x["speaker_id"]), lambda s: s.isNotNull()), F.lit(0)).alias("speaker_id"))
    return out.withColumnRenamed("island", "position")


def restore_commas(segments: DataFrame, key: str = "doc_id", order: str = "position", endings=("て", "で"), comma=lx.COMMA) -> DataFrame:
    """A comma after a connective ending, for all but a document's last segment."""
    w = ordered([key], [order])
    hit = F.lead(F.lit(1)).over(w).isNotNull() & compact(F.col("text")).rlike("(?:" + "|".join(endings) + ")$")
    return segments.withColumn("text", F.when(hit, F.concat(F.rtrim("text"), F.lit(comma))).otherwise(F.col("text")))


def split_sentences(words: DataFrame, keys: list[str], marks=lx.TERMINAL_MARKS, suffixes=lx.FINAL_SUFFIXES, particles=lx.FINAL_PARTICLES, prefixes=lx.CONTINUATION_PREFIXES, strong=lx.STRONG_PAUSE, pause=lx.MIN_PAUSE) -> DataFrame:
    """Boundary decisions of sentences: (keys, word_idx, gap, reason, left_text, right_text).

    words(word_idx, text (normalised), start, end). What is left of a word counts from the last boundary, so a
    sentence's words are folded, by one pass of a function over its text without white space; the texts of the
    decisions are cut after it. Rules are tried in order: a terminal mark splits; a final particle, a dependent prefix,
    or a digit after an unfinished text never does; a strong pause, a repeated heading and a sentence-final text do.
    """
    w = ordered(keys, ["word_idx"])
    text = F.coalesce("text", F.lit(""))
    words = words.select(*keys, "word_idx", text.alias("text"), compact(text).alias("c"), (F.lead("start").over(w) - F.col("end")).cast("double").alias("gap"), ends_with_any(text, marks).alias("mark"))
    flags = sum((F.when(flag, bit).otherwise(0) for bit, flag in ((MARK, F.col("mark")), (STRONG, F.col("gap") >= strong), (PAUSE, F.col("gap") >= pause))), F.lit(0))
    words = words.withColumns({"at": F.sum(F.length("text")).over(w).cast("int"), "at_c": F.sum(F.length("c")).over(w).cast("int"), "flags": flags})
    a = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("word_idx").cast("int").alias("word_idx"), "at", "at_c", "gap", "flags", "text", "c"))).alias("a")).where(F.size("a") > 1)

    def each(field):
        return F.transform("a", lambda x: x[field])

    a = a.withColumn("b", boundaries(marks, suffixes, particles, prefixes)(F.array_join(each("c"), ""), each("at"), each("at_c"), each("flags")))

    def decision(b, i):
        x, first = F.get("a", F.shiftright(b, 3)), F.get("a", F.shiftright(F.get("b", i - 1), 3))["at"]
        reason = F.element_at(F.array(*map(F.lit, REASONS)), b.bitwiseAND(7))
        return F.struct(x["word_idx"].alias("word_idx"), F.greatest(x["gap"], F.lit(0.0)).alias("gap"), reason.alias("reason"), F.coalesce(first, F.lit(0)).alias("first"), x["at"].alias("at"))

    d = a.select(*keys, F.array_join(each("text"), "").alias("t"), F.explode(F.transform("b", decision)).alias("d"))
    t = F.col("t")
    cut = F.substring(t, F.col("d.first") + 1, F.col("d.at") - F.col("d.first"))
    return d.select(*keys, "d.word_idx", "d.gap", "d.reason", cut.alias("left_text"), F.substring(t, F.col("d.at") + 1, F.length(t)).alias("right_text"))


def boundaries(marks, suffixes, particles, prefixes):
    """A function of sentences (text without white space, ends of words with and without it, their flags): boundaries as 8 * word + reason."""
    marks, suffixes, blocked, quotes = tuple(marks), tuple(suffixes), (*particles, *prefixes), "".join(lx.CLOSING_QUOTES)

    def same(u, a, b, n):
        # by growing pieces, as most texts differ soon
        done, piece = 0, 16
        while done < n:
            end = min(done + piece, n)
            if u[a + done : a + end] != u[b + done : b + end]:
                return False
            done, piece = end, 2 * piece
        return True

    def walk(u, at, at_c, flags):
        out, end = [], at[-1]
        first = first_c = solid = before = 0
        for i in range(len(at) - 1):
            here, flag = at_c[i], flags[i]
            # up to where the text has no closing quotes at its end
            said = len(u[before:here].rstrip(quotes))
            solid, before = before + said if said else solid, here
            if not first < at[i] < end:
                continue
            width, reason = here - first_c, 0
            if flag & MARK or u.endswith(marks, first_c, solid):
                reason = 1
            elif not u.startswith(blocked, here):
                final = u.endswith(suffixes, first_c, solid)
                if final or not u[here : here + 1].isdecimal():
                    if flag & STRONG:
                        reason = 2
                    elif width >= 2 and u[first_c : first_c + 2] == u[here : here + 2] and same(u, first_c, here, width):
                        reason = 3
                    elif final:
                        reason = 4 if flag & PAUSE else 5
            if reason:
                out.append(8 * i + reason)
                first, first_c = at[i], here
        return out

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def folded(u: pd.Series, at: pd.Series, at_c: pd.Series, flags: pd.Series) -> pd.Series:
        return pd.Series([walk(s, *(x.tolist() for x in row)) for s, *row in zip(u, at, at_c, flags)], dtype=object)

    return folded
